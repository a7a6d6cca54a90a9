"""File tables: listings, trees, samples, changes, duplicates, hints, uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fossick.functions.matching import depth, in_globs
from fossick.functions.text import extension, parent, stem


def select_files(files: DataFrame, root: str, *, max_depth: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None, extensions: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """Files below ``root`` that the options admit."""
    out = files.where(F.col("path").startswith(root.rstrip("/") + "/")).where(in_globs(F.col("path"), include, exclude))
    if max_depth is not None:
        out = out.where(depth(F.col("path"), root) <= max_depth)
    if extensions:
        out = out.where(extension(F.col("path")).isin([e.lstrip(".").lower() for e in extensions]))
    if not hidden:
        out = out.where(~F.substring("path", len(root.rstrip("/")) + 1, 100_000).rlike(r"/\."))
    return out


def tree(files: DataFrame) -> DataFrame:
    """(folder, n_files, total_bytes)."""
    return files.groupBy(parent(F.col("path")).alias("folder")).agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes"))


def common_root(files: DataFrame) -> DataFrame:
    """One row: the longest folder that holds all files; it is that of the least and the greatest path."""
    m = files.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    parts = F.zip_with(F.split(parent(F.col("a")), "/"), F.split(parent(F.col("b")), "/"), lambda x, y: F.when(x == y, x))
    upto = F.array_position(F.transform(parts, lambda x: x.isNull()), True)
    return m.select(F.array_join(F.when(upto > 0, F.slice(parts, 1, (upto - 1).cast("int"))).otherwise(parts), "/").alias("root"))


def stratified(files: DataFrame, budget: int, newest: str = "modified_at") -> DataFrame:
    """The newest files of each folder, in proportion to its number of files and one at least; over the budget, the
    newest of all."""
    f = files.withColumn("folder", parent(F.col("path")))
    per = f.groupBy("folder").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    share = per.crossJoin(F.broadcast(total)).select("folder", F.greatest(F.lit(1), F.floor(budget * F.col("n") / F.col("total"))).alias("share"))
    w = Window.partitionBy("folder").orderBy(F.desc(newest), "path")
    return f.withColumn("r", F.row_number().over(w)).join(share, "folder").where(F.col("r") <= F.col("share")).orderBy(F.desc(newest), "path").limit(budget).drop("r", "share")


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, modified_at) that ``known`` doesn't hold as they are."""
    return files.join(known.select("path", "modified_at"), ["path", "modified_at"], "left_anti")


def duplicate_names(new: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, is_duplicate, known_size) of uploads (name) against a manifest (name, size_bytes)."""
    known = manifest.groupBy("name").agg(F.max("size_bytes").alias("known_size"))
    return new.join(known, "name", "left").select("name", F.col("known_size").isNotNull().alias("is_duplicate"), "known_size")


def resolve_hints(files: DataFrame, hints: DataFrame, limit: int = 20) -> DataFrame:
    """(hint, path, place): files whose name holds a hint, or has its stem; the best ``limit`` a hint.

    ``hints`` is a short list typed by a user.
    """
    name, hint = F.lower("filename"), F.lower("hint")
    kind = F.when(F.col("filename") == F.col("hint"), 1).when(name.contains(hint), 2).when(F.lower(stem(F.col("filename"))) == F.lower(stem(F.col("hint"))), 3)
    hit = files.join(hints, name.contains(hint) | (F.lower(stem(F.col("filename"))) == F.lower(stem(F.col("hint"))))).withColumn("kind", kind).where("kind IS NOT NULL")
    return hit.withColumn("place", F.row_number().over(Window.partitionBy("hint").orderBy("kind", "path"))).where(F.col("place") <= limit).select("hint", "path", "place")


def store_uploads(manifest: DataFrame, uploads: DataFrame, *, max_bytes: int, extensions: list[str], quota: int | None = None) -> DataFrame:
    """The manifest with the uploads (collection, name, content, upload_time) that are admitted: of a valid collection,
    not empty, at most ``max_bytes``, of an admitted extension and, in the order of upload_time, within the ``quota``
    of bytes that a collection may hold with what it has.

    A name that is free goes to the first upload of it; every other upload gets the least free number of ``_1``, ``_2``
    ... before its extension. No name is issued twice. Ranks and running counts, so no task holds a collection.
    """
    size = F.length("content")
    ok = uploads.where(F.col("collection").rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$") & (size > 0) & (size <= max_bytes) & extension(F.col("name")).isin(extensions))
    rows = ok.select("collection", "name", size.cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "upload_time")
    if quota is not None:
        have = manifest.groupBy("collection").agg(F.sum("size_bytes").alias("have"))
        used = F.sum("size_bytes").over(Window.partitionBy("collection").orderBy("upload_time", "sha256", "name").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("used", used).join(have, "collection", "left").where(F.col("used") + F.coalesce("have", F.lit(0)) <= quota).drop("used", "have")
    order = Window.partitionBy("collection", "name").orderBy("upload_time", "sha256")
    known = manifest.select("collection", "name").distinct().withColumn("known", F.lit(1))
    rows = rows.join(known, ["collection", "name"], "left").withColumn("place", F.row_number().over(order) - 1 + F.coalesce("known", F.lit(0))).drop("known")
    ext, base = F.regexp_extract("name", r"(?<=.)\.[^.]*$", 0), F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    # names that look like a numbered one are taken numbers of its stem
    names = manifest.select("collection", "name").unionAll(rows.where("place = 0").select("collection", "name")).distinct()
    number = F.regexp_extract(base, r"_([1-9][0-9]{0,8})$", 1)
    taken = names.where(number != "").select("collection", F.concat(F.regexp_replace(base, r"_[0-9]+$", ""), ext).alias("name"), number.cast("int").alias("n"))
    w = Window.partitionBy("collection", "name")
    # of a taken number, how many free ones there are below it
    taken = taken.select("collection", "name", (F.col("n") - F.row_number().over(w.orderBy("n"))).alias("free"))
    more = rows.where("place > 0").select("*", (F.col("place") - 1).alias("free"), F.lit(0).alias("mark"))
    marks = taken.select("collection", "name", F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast(rows.schema["upload_time"].dataType).alias("upload_time"), F.lit(None).cast("int").alias("place"), "free", F.lit(1).alias("mark"))
    below = F.sum("mark").over(w.orderBy("free", F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0))
    numbered = more.unionByName(marks).withColumn("n", F.col("place") + below).where("mark = 0")
    numbered = numbered.withColumn("name", F.concat(base, F.lit("_"), F.col("n").cast("string"), ext))
    keep = ["collection", "name", "size_bytes", "sha256", "upload_time"]
    return manifest.unionByName(rows.where("place = 0").select(*keep)).unionByName(numbered.select(*keep))


def valid_paths(paths: DataFrame) -> DataFrame:
    """(path, pos) of search paths (path, pos) that can be used, each at its first position.

    Blank ones, those with a NUL, a leading hyphen or a URL without a host drop out; so do those that leave their root
    by ``..``.
    """
    p = F.trim("path")
    bad = (p == "") | p.contains("\x00") | p.startswith("-") | p.rlike(r"^[a-z]+://(?:/|$)") | p.rlike(r"(?:^|/)\.\.(?:/|$)")
    return paths.where(F.col("path").isNotNull() & ~bad).groupBy(p.alias("path")).agg(F.min("pos").alias("pos"))


def allowed(paths: DataFrame, roots: list[str]) -> DataFrame:
    """Paths at or below one of ``roots``."""
    from fossick.functions.matching import inside

    return paths.where(F.coalesce(*[F.when(inside(F.col("path"), F.lit(r)), True) for r in roots], F.lit(False)))
