"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash of their id and cut into blocks of ``BLOCK`` tokens (of the last block
of a source, what is left). Slot k of the schedule holds the golden-ratio point k * 2654435769 modulo 2**32; the
cumulative weights map it to a source, and its rank among the source's slots says which block it takes. So every run of
slots has each source in its share, to within a few slots. The schedule ends when every source has had all its blocks;
sources whose weight is above their share of tokens begin anew meanwhile (``epoch``).

Weights are given by source, or are the three-quarter power of the source's tokens, of one block at least: between
proportional and equal, and a source of a few tokens doesn't make the others wait for its block. However small a weight
that is given, its source has a point of 2**32: the schedule is then as long as that takes.
Everything is whole numbers or correctly rounded roots, so any engine gives the same schedule. A token is a maximal run
of characters that aren't blanks; ``tokens_col`` names a column of exact counts instead.

Distributed: documents are ordered inside 4096 ranges of the hash per source and slots inside runs of 65536; only their
totals are summed up across. Texts are shuffled by ``apply_schedule`` alone, never by ``schedule``.

Defined results: a null source counts as the empty name; a null, empty or blank text counts one token, so that it is
scheduled; rows of one id are ordered by their tokens; repeated rows are each scheduled; a source without a weight in
given weights has no slots; an empty table gives an empty schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fossick.llm.common import col, fresh, write_table
from fossick.llm.quality import WORD

BLOCK = 1 << 16
GOLDEN = 2654435769
_RUN = 1 << 16
_BIN = 1 << 20


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokens_col: str | None) -> list[Column]:
    """source, id, hash and tokens of every row."""
    text = col(text_col).cast("string")
    tokens = col(tokens_col) if tokens_col else F.regexp_count(text, F.lit(WORD))
    return [
        F.coalesce(col(source_col).cast("string"), F.lit("")).alias("source"), col(id_col).alias("doc_id"),
        F.md5(F.coalesce(col(id_col).cast("string"), F.lit("null")).cast("binary")).alias("hash"),
        F.greatest(F.lit(1), F.coalesce(tokens, F.lit(0))).cast("bigint").alias("tokens"),
    ]


def _placed(rows: DataFrame, sums: DataFrame, order: list) -> DataFrame:
    """``rows`` (source, hash, tokens, ...) with ``start``: the tokens of the source ahead of each."""
    w = Window.partitionBy("source", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("tokens").over(w), F.lit(0))
    return rows.withColumn("inside", inside).join(sums, ["source", "range"]).withColumn("start", F.col("inside") + F.col("ahead")).drop("inside", "ahead")


def _range_sums(rows: DataFrame) -> DataFrame:
    """(source, range, ahead): tokens of a source before each range of its hashes."""
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("source", "range").agg(F.sum("tokens").alias("t")).select("source", "range", "t", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("ahead"))


def source_shares(sums: DataFrame, weights: dict[str, int] | None, block: int) -> DataFrame:
    """(source, tokens, blocks, lo, hi): one row a source, with its part [lo, hi) of 0..2**32."""
    t = sums.groupBy("source").agg(F.sum("t").alias("tokens"))
    if weights is None:
        root = F.sqrt(F.greatest(F.col("tokens"), F.lit(block)).cast("double"))
        q = F.floor(root * F.sqrt(root)).cast("bigint")
    else:
        q = F.coalesce(*[F.when(F.col("source") == k, F.lit(int(v))) for k, v in weights.items()], F.lit(0)).cast("bigint")
    every = Window.partitionBy(F.lit(0))
    run = every.orderBy("source")
    t = t.withColumn("q", q).where("q > 0")
    t = t.withColumn("total", F.sum("q").over(every)).withColumn("upto", F.sum("q").over(run)).withColumn("n", F.count("*").over(every)).withColumn("i", F.row_number().over(run))
    # every source has a point of its own besides its share of the rest
    point = lambda c: F.floor(c.cast("double") / F.col("total").cast("double") * (F.lit(4294967296.0) - F.col("n"))).cast("bigint") + F.col("i")
    return t.select("source", "tokens", F.expr(f"(tokens + {block - 1}) div {block}").alias("blocks"), (point(F.col("upto") - F.col("q")) - 1).alias("lo"), point(F.col("upto")).alias("hi"))


def slots(shares: DataFrame) -> DataFrame:
    """(slot, source, rank, block, epoch) of the whole schedule; ``shares`` has a row a source."""
    spark = shares.sparkSession
    # enough slots that every source has had its blocks, whatever the discrepancy: it stays under 3 + log2(slots) * 2
    most = shares.agg(F.max(F.ceil((F.col("blocks") + 128) * F.lit(4294967296.0) / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))))).first()[0]
    if most is None:
        return spark.createDataFrame([], "slot bigint, source string, rank bigint, block bigint, epoch bigint")
    k = spark.range(int(most)).select(F.col("id").alias("slot"), F.expr(f"(id * {GOLDEN}) % 4294967296").alias("u"), F.expr(f"id div {_RUN}").alias("run"))
    # points and sources meet by bins of the points, so the join has equal keys however many sources there are
    bins = shares.select("source", "blocks", "lo", "hi", F.explode(F.expr(f"sequence(lo div {_BIN}, (hi - 1) div {_BIN})")).alias("bin"))
    hit = k.withColumn("bin", F.expr(f"u div {_BIN}")).join(bins, "bin").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "run", "source", "blocks")
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = hit.groupBy("source", "run").agg(F.count("*").alias("n")).select("source", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = hit.withColumn("inside", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1).join(runs, ["source", "run"])
    ranked = ranked.select("slot", "source", (F.col("inside") + F.col("ahead")).cast("bigint").alias("rank"), "blocks")
    ranked, _ = write_table(ranked)
    last = ranked.where("rank = blocks - 1").agg(F.max("slot")).first()[0]
    return ranked.where(F.col("slot") <= last).select("slot", "source", "rank", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("epoch"))


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None) -> DataFrame:
    """(slot, source, epoch, block, doc_id, from_token, n_tokens): what each slot holds, documents cut at block borders.

    ``from_token`` counts from the document's begin.
    """
    rows, _ = write_table(docs.select(*_measured(docs, id_col, text_col, source_col, tokens_col)).withColumn("range", F.substring("hash", 1, 3)))
    sums, _ = write_table(_range_sums(rows))
    place = _placed(rows, sums.drop("t"), ["hash", "doc_id", "tokens"])
    cut = place.select("source", "doc_id", "tokens", "start", F.explode(F.expr(f"sequence(start div {block}, (start + tokens - 1) div {block})")).alias("block"))
    begin, end = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("tokens"), (F.col("block") + 1) * block)
    cut = cut.select("source", "block", "doc_id", (begin - F.col("start")).alias("from_token"), (end - begin).alias("n_tokens"))
    return slots(source_shares(sums, weights, block)).join(cut, ["source", "block"]).select("slot", "source", "epoch", "block", "doc_id", "from_token", "n_tokens")


def apply_schedule(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None) -> DataFrame:
    """``docs`` as mixed: every document whole, in the block of its first token, once for each slot of that block.

    The same columns; partitions follow each other in the order of slots. Every document occurs at least once, unless
    its source has no weight.
    """
    key, slot, part, place_no = fresh(docs, "__key", "__slot", "__part", "__place")
    # rows of one key are equal in all columns, so it doesn't matter which of them stands where
    row = F.xxhash64(*[col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    s, _, h, t = _measured(docs, id_col, text_col, source_col, tokens_col)
    rows, _ = write_table(docs.select(s, h, t, row.alias("row")).withColumn("range", F.substring("hash", 1, 3)))
    sums, _ = write_table(_range_sums(rows))
    plan, _ = write_table(slots(source_shares(sums, weights, block)))
    place = _placed(rows, sums.drop("t"), ["hash", "tokens", "row"]).select("source", F.expr(f"start div {block}").alias("block"), "row")
    where = place.join(plan, ["source", "block"]).select(F.col("row").alias(key), F.col("slot").alias(slot))
    once = docs.withColumn(key, row).withColumn(place_no, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).where(F.col(place_no) == 1)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = (plan.agg(F.max("slot")).first()[0] or 0) + 1
    mixed = once.join(where, key).withColumn(part, (F.col(slot) * n / every).cast("int"))
    return mixed.repartitionById(n, F.col(part)).sortWithinPartitions(slot).select(*[col(c) for c in docs.columns])


def schedule_sql(block: int = BLOCK) -> str:
    """DuckDB SQL for ``schedule`` over documents with weights from the tokens."""
    return f"""
WITH measured AS (
  SELECT coalesce(source, '') AS source, doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS hash,
         greatest(1, coalesce(length(regexp_extract_all(text, '{WORD}')), 0)) AS tokens FROM documents),
placed AS (
  SELECT source, doc_id, tokens, CAST(coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY hash, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM measured),
cut AS (
  SELECT source, doc_id, tokens, start, unnest(range(start // {block}, (start + tokens - 1) // {block} + 1)) AS block FROM placed),
pieces AS (
  SELECT source, block, doc_id, greatest(start, block * {block}) - start AS from_token,
         least(start + tokens, (block + 1) * {block}) - greatest(start, block * {block}) AS n_tokens FROM cut),
per AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM measured GROUP BY source),
rooted AS (SELECT source, tokens, CAST(floor(sqrt(CAST(greatest(tokens, {block}) AS DOUBLE)) * sqrt(sqrt(CAST(greatest(tokens, {block}) AS DOUBLE)))) AS BIGINT) AS q FROM per),
summed AS (SELECT source, tokens, q, CAST(sum(q) OVER () AS DOUBLE) AS total, CAST(sum(q) OVER (ORDER BY source) AS BIGINT) AS upto, count(*) OVER () AS n, row_number() OVER (ORDER BY source) AS i FROM rooted),
shares AS (
  SELECT source, (tokens + {block - 1}) // {block} AS blocks, CAST(floor(CAST(upto - q AS DOUBLE) / total * (4294967296.0::DOUBLE - n)) AS BIGINT) + i - 1 AS lo,
         CAST(floor(CAST(upto AS DOUBLE) / total * (4294967296.0::DOUBLE - n)) AS BIGINT) + i AS hi FROM summed),
points AS (
  SELECT slot, (slot * {GOLDEN}) % 4294967296 AS u
  FROM (SELECT unnest(range((SELECT CAST(max(ceil((blocks + 128) * 4294967296.0 / greatest(1, hi - lo))) AS BIGINT) FROM shares))) AS slot)),
ranked AS (
  SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM points JOIN shares ON u >= lo AND u < hi),
plan AS (
  SELECT slot, source, rank % blocks AS block, rank // blocks AS epoch
  FROM ranked WHERE slot <= (SELECT max(slot) FROM ranked WHERE rank = blocks - 1))
SELECT slot, source, epoch, block, doc_id, from_token, n_tokens FROM plan JOIN pieces USING (source, block)
"""
