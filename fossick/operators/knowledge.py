"""Knowledge clusters: lookup, similarity, statistics, graph, upsert, merge, split, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fossick.functions.encoders import Encoder, text_hash
from fossick.functions.matching import inside
from fossick.functions.scoring import cosine


def find(clusters: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, name, priority): clusters with ``query`` in id, name, description, content or a pattern; cases differ.

    The id itself comes first, then names that begin with it, then descriptions, then the rest.
    """
    text = F.array_join("description", "\n")
    hit = F.col("id").contains(query) | F.col("name").contains(query) | text.contains(query) | F.col("content").contains(query) | F.exists("patterns", lambda p: p.contains(query))
    order = F.when(F.col("id") == query, 1).when(F.col("name").startswith(query), 2).when(text.contains(query), 3).otherwise(4)
    return clusters.where(F.coalesce(hit, F.lit(False))).select("id", "name", order.alias("priority")).orderBy("priority", "id").limit(limit)


def get(clusters: DataFrame, cluster_id: str) -> DataFrame:
    """The cluster of this id, or no row. The condition reaches the scan."""
    return clusters.where(F.col("id") == cluster_id)


def activity(clusters: DataFrame, values: tuple[str, ...], newest: str = "create_time", most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(total, mean_confidence, a count for each lifecycle of ``values`` as a map) in one row and one pass, and the
    ``most`` newest clusters (id, name, lifecycle, confidence, changed)."""
    count = F.create_map(*[x for v in values for x in (F.lit(v), F.count_if(F.col("lifecycle") == v))])
    one = clusters.agg(F.count("*").alias("total"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("mean_confidence"), count.alias("lifecycles"))
    return one, clusters.select("id", "name", "lifecycle", "confidence", F.col(newest).alias("changed")).orderBy(F.desc_nulls_last("changed"), "id").limit(most)


def references(clusters: DataFrame, most: int = 3) -> DataFrame:
    """(id, file, summary, snippets): the evidence that was found, each with its first ``most`` snippets."""
    e = clusters.select("id", F.posexplode(F.filter("evidences", lambda e: e["is_found"])).alias("pos", "e"))
    kinds = {f.name for f in e.schema["e"].dataType.fields}
    summary = F.coalesce("e.summary", F.lit("")) if "summary" in kinds else F.lit("")
    snippets = F.slice(F.coalesce("e.snippets", F.array().cast("array<string>")), 1, most) if "snippets" in kinds else F.array().cast("array<string>")
    return e.select("id", F.col("e.file").alias("file"), summary.alias("summary"), snippets.alias("snippets"), "pos")


def listing(clusters: DataFrame, *, lifecycle: str | None = None, level: str | None = None, sort_by: str = "hotness", limit: int = 100) -> DataFrame:
    if lifecycle:
        clusters = clusters.where(F.col("lifecycle") == lifecycle)
    if level:
        clusters = clusters.where(F.col("abstraction_level") == level)
    return clusters.orderBy(F.desc_nulls_last(sort_by), "id").limit(limit)


def similar(clusters: DataFrame, vector: list[float], *, top_k: int = 3, threshold: float = 0.85, pre_filter: bool = False) -> DataFrame:
    """(id, similarity): the ``top_k`` most similar clusters, of them those at the threshold.

    The cut comes first, unless ``pre_filter``. One pass over the vectors; no join.
    """
    q = F.array(*[F.lit(float(x)) for x in vector])
    s = clusters.where("embedding_vector IS NOT NULL").select("*", F.round(cosine(F.col("embedding_vector"), q), 6).alias("similarity")).where("similarity IS NOT NULL")
    if pre_filter:
        s = s.where(F.col("similarity") >= threshold)
    return s.orderBy(F.desc("similarity"), "id").limit(top_k).where(F.col("similarity") >= threshold)


def path_coverage(clusters: DataFrame, roots: list[str]) -> DataFrame:
    """(id, coverage): the share of a cluster's evidence files at or below one of the roots; 0 without files."""
    f = clusters.select("id", F.explode_outer("evidences").alias("e")).select("id", F.col("e.file").alias("file"))
    hit = F.coalesce(*[F.when(inside(F.col("file"), F.lit(r)), True) for r in roots], F.lit(False))
    return f.groupBy("id").agg(F.coalesce(F.avg(F.when(F.col("file").isNotNull(), hit.cast("int"))), F.lit(0.0)).alias("coverage"))


def similar_in_scope(clusters: DataFrame, vector: list[float], roots: list[str], *, top_k: int = 3, threshold: float = 0.85, coverage: float = 0.5) -> DataFrame:
    found = similar(clusters, vector, top_k=top_k, threshold=threshold)
    return found.select("id", "similarity").join(path_coverage(found, roots), "id").where(F.col("coverage") >= coverage)


def value_counts(clusters: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(value, n) for every one of ``values``, those that don't occur too."""
    spark = clusters.sparkSession
    every = spark.createDataFrame([(v,) for v in values], "value string")
    got = clusters.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return every.join(got, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def stats(clusters: DataFrame) -> DataFrame:
    """One row of totals in one pass."""
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return clusters.agg(
        F.count("*").alias("total"), F.count_if(F.col("embedding_vector").isNotNull()).alias("embedded"),
        *[x for c in ("confidence", "hotness") for x in (r(F.min(c)).alias(f"min_{c}"), r(F.max(c)).alias(f"max_{c}"), r(F.avg(c)).alias(f"avg_{c}"))],
    )


def timeline(clusters: DataFrame, now: str, days: int = 30) -> DataFrame:
    """(day, n) of clusters created in the last ``days`` days."""
    at = F.lit(now).cast("timestamp_ntz")
    return clusters.where((F.col("create_time") >= at - F.make_dt_interval(F.lit(days))) & (F.col("create_time") <= at)).groupBy(F.to_date("create_time").alias("day")).agg(F.count("*").alias("n"))


def top_patterns(clusters: DataFrame, limit: int = 20) -> DataFrame:
    return clusters.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(limit)


def graph_edges(clusters: DataFrame) -> DataFrame:
    """(id, target, weight, source) of every edge."""
    return clusters.select("id", F.inline("related_clusters"))


def evidence_files(clusters: DataFrame) -> DataFrame:
    """(id, doc_ids): different documents of the evidence that was found, sorted."""
    return clusters.select("id", F.array_sort(F.array_distinct(F.transform(F.filter("evidences", lambda e: e["is_found"]), lambda e: e["doc_id"]))).alias("doc_ids"))


def content_id(*parts: Column) -> Column:
    """``C`` and ten hex digits of the SHA-256 of the trimmed parts that aren't empty, with blank lines between."""
    kept = F.filter(F.array(*[F.trim(p) for p in parts]), lambda x: x != "")
    return F.concat(F.lit("C"), F.substring(F.sha2(F.array_join(kept, "\n\n"), 256), 1, 10))


def query_id(query: Column, prefix: str = "FS") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(query, 256), 1, 8))


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and the rows of ``new`` whose id it lacks."""
    return old.unionByName(new.join(old.select("id"), "id", "left_anti"), allowMissingColumns=True)


def update(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of rows that ``new`` has too take its values where they aren't null; their version goes up."""
    n = new.select("id", F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    j = old.join(n, "id", "left")
    out = {c: F.coalesce(f"_n_{c}", c).alias(c) if c in columns else (F.col(c) + F.when(F.col("_new"), 1).otherwise(0)).cast("int").alias(c) if c == "version" else F.col(c) for c in old.columns}
    return j.select(*out.values())


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` in place of rows with the same id; their version is one above the one replaced."""
    before = old.select("id", F.col("version").alias("_v"))
    fresh = new.join(before, "id", "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + 1).cast("int")).drop("_v")
    return old.join(new.select("id"), "id", "left_anti").unionByName(fresh)


def remove(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids.select("id"), "id", "left_anti")


def store_embedding(old: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors (id, vector) for their clusters; another length than ``dim`` fails."""
    checked = vectors.select("id", F.when(F.assert_true(F.size("vector") == dim).isNull(), F.col("vector")).alias("_vec"))
    return old.join(checked, "id", "left").withColumn("embedding_vector", F.coalesce("_vec", "embedding_vector")).drop("_vec")


def merged_parts(clusters: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``merge`` puts together, as rows, so that none grows with its group: one of (key, n_merged, name, confidence,
    hotness, version) for each key, and different (key, kind, text), (key, doc_id, at), (key, target, weight, at).

    ``at`` orders documents by their first arrival and edges by their last. Rows of one ``order`` arrive by name. The
    edges of one target meet in one row, for its average.
    """
    c = clusters.withColumn("_at", F.struct(F.col(order).alias("order"), "name", F.xxhash64("description", "patterns", "evidences", "related_clusters").alias("digest"), F.monotonically_increasing_id().alias("row")))
    heads = clusters.groupBy(key).agg(
        F.count("*").alias("n_merged"), F.concat(F.min(F.struct(order, "name"))["name"], F.lit(" (merged)")).alias("name"), F.avg("confidence").alias("confidence"), F.avg("hotness").alias("hotness"), (F.max("version") + 1).cast("int").alias("version"),
    )
    each = lambda kind: clusters.select(key, F.lit(kind).alias("kind"), F.explode(kind).alias("text"))
    texts = each("description").unionByName(each("patterns")).distinct()
    spread = lambda column: c.select(key, "_at", F.posexplode(column).alias("pos", "e")).withColumn("_at", F.struct("_at", "pos"))
    documents = spread("evidences").groupBy(key, F.col("e.doc_id").alias("doc_id")).agg(F.min("_at").alias("at"))
    weights = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col("e.weight").cast("double").alias("weight")))), lambda x: x["weight"])
    mean = F.aggregate(weights, F.lit(None).cast("double"), lambda m, w: F.coalesce((m + w) / 2, w))
    edges = spread("related_clusters").groupBy(key, F.col("e.target").cast("bigint").alias("target")).agg(mean.alias("weight"), F.max("_at").alias("at"))
    return heads, texts, documents, edges


def merged_texts(texts: DataFrame, key: str) -> DataFrame:
    """(key, description, patterns) of the texts of ``merged_parts``, sorted."""
    of = lambda kind: F.array_sort(F.transform(F.collect_list(F.when(F.col("kind") == kind, F.struct("text"))), lambda x: x["text"])).alias(kind)
    return texts.groupBy(key).agg(of("description"), of("patterns"))


def by_key(key: str, *tables: DataFrame) -> DataFrame:
    """The columns of tables with at most one row for each key, side by side; a null is a key too."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    return every.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in every.columns if c != key])


def merge(clusters: DataFrame, key: str, order: str) -> DataFrame:
    """One cluster for each ``key``: different descriptions and patterns in sorted order, evidence once for each
    document in arrival order, mean confidence and hotness, edge weights averaged pair by pair as they arrive, the
    highest version and one. ``merged_parts`` has the same without a row that holds a whole group."""
    heads, texts, documents, edges = merged_parts(clusters, key, order)
    doc_ids = documents.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    weights = edges.groupBy(key).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("at", "target", "weight"))), lambda x: F.struct(x["target"], x["weight"]))).alias("edges"))
    m = by_key(key, heads, merged_texts(texts, key), doc_ids, weights)
    none = F.array().cast("array<string>")
    return m.select(
        key, "n_merged", "name", *[F.coalesce(c, none).alias(c) for c in ("description", "patterns", "doc_ids")], F.coalesce("edges", F.expr("cast(map() as map<bigint,double>)")).alias("edges"), "confidence", "hotness", "version"
    )


def split(clusters: DataFrame, n: int) -> DataFrame:
    """(id, name, evidences, patterns, lifecycle, version): ``n`` parts of each cluster: runs of its evidence, the last
    with the rest, and patterns dealt in turn. A cluster with less evidence than parts stays as it is, and so do all if
    there are fewer than two parts."""
    whole = (F.size("evidences") < n) if n >= 2 else F.lit(True)
    s = clusters.select("id", "name", "evidences", "patterns", "lifecycle", "version", whole.alias("whole"), F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))).alias("part"))
    each = F.expr(f"greatest(1, size(evidences) div {max(1, n)})")
    begin = F.col("part") * each
    size = F.when(F.col("part") == n - 1, F.greatest(F.lit(0), F.size("evidences") - begin)).otherwise(each)
    number = (F.col("part") + 1).cast("string")
    cut = {
        "id": F.concat("id", F.lit("_split"), number), "name": F.concat("name", F.lit(" (part "), number, F.lit(")")), "evidences": F.slice("evidences", begin + 1, size),
        "patterns": F.filter("patterns", lambda _, i: i % max(1, n) == F.col("part")), "lifecycle": F.lit("EMERGING"), "version": F.lit(1),
    }
    return s.select(*[F.when(F.col("whole"), F.col(c)).otherwise(v).alias(c) for c, v in cut.items()])


def add_query(queries: Column, query: Column, most: int = 5) -> Column:
    """The query behind the others unless it is there; only the last ``most`` stay."""
    added = F.array_append(queries, query)
    return F.when(F.array_contains(queries, query), queries).when(F.size(added) > most, F.slice(added, -most, most)).otherwise(added)


def bump_hotness(hotness: Column) -> Column:
    return F.least(F.lit(1.0), F.when(F.coalesce(hotness, F.lit(0.0)) == 0, F.lit(0.5)).otherwise(hotness) + 0.1)


def reuse(clusters: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """All clusters; those in ``hits`` (id) have the query added, are hotter and a version up."""
    j = clusters.join(hits.select("id", F.lit(True).alias("_hit")), "id", "left")
    on = F.col("_hit")
    changed = {"queries": add_query(F.col("queries"), F.lit(query)), "hotness": bump_hotness(F.col("hotness")), "version": (F.col("version") + 1).cast("int")}
    return j.select(*[F.when(on, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in clusters.columns])


def reuse_and_embed(clusters: DataFrame, hits: DataFrame, query: str, encoder: Encoder) -> DataFrame:
    """As ``reuse``; the vectors of the hits are those of all their queries now, with the model's name and the text's
    hash, so that a later search meets what the cluster has come to answer."""
    out = reuse(clusters, hits, query).join(hits.select("id", F.lit(True).alias("_hit")), "id", "left")
    text = F.when(F.col("_hit"), F.array_join("queries", "\n"))
    has = set(clusters.columns)
    new = {"embedding_vector": encoder.columns(F.col("_text")), "embedding_model": F.lit(encoder.name), "embedding_text_hash": text_hash(F.col("_text"))}
    out = out.withColumn("_text", text).withColumns({f"_new_{c}": v for c, v in new.items()})
    keep = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in clusters.columns]
    more = [F.when(F.col("_hit"), F.col(f"_new_{c}")).alias(c) for c in new if c not in has]
    return out.select(*keep, *more)


def still_there(clusters: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file): evidence files that ``files`` (path) still lists."""
    return clusters.select("id", F.explode("evidences").alias("e")).select("id", F.col("e.file").alias("path")).join(files.select("path"), "path", "left_semi").select("id", F.col("path").alias("file"))
