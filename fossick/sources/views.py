"""Views over the driver's tables that stand for what a search engine keeps: files, lines, clusters, chats, usage.

Each is a DataFrame here and a DuckDB common table expression in ``SQL``, so that a query and its SQL start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fossick.functions.matching import any_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
LIFECYCLES = ("STABLE", "EMERGING", "CONTESTED", "DEPRECATED")
LEVELS = ("TECHNIQUE", "PRINCIPLE", "PARADIGM", "FOUNDATION", "PHILOSOPHY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, filename, extension, source, lang, size_bytes, content)."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("/", F.lit("/corpus"), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name).alias("path"), name.alias("filename"), F.lit("txt").alias("extension"),
        F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"), F.col("n_chars").alias("size_bytes"), F.coalesce("text", F.lit("")).alias("content"),
    )


def lines_of(files: DataFrame, holding: list[str] | None = None) -> DataFrame:
    """(doc_id, path, line_number, line): lines from 1; what follows the last newline counts if it isn't empty.

    ``holding``: literals of which the caller wants lines, whatever the case: files with none of them aren't cut up.
    """
    if holding:
        files = files.where(any_of(F.col("content"), holding))
    parts = F.split("content", "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("doc_id", "path", F.posexplode(whole).alias("pos", "line")).select("doc_id", "path", (F.col("pos") + 1).alias("line_number"), "line")


def lines(spark: SparkSession, sf_dir: str, holding: list[str] | None = None) -> DataFrame:
    return lines_of(corpus(spark, sf_dir), holding)


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge clusters, one for each vector: the store's columns that queries use, nested ones as arrays of structs."""
    v = table(spark, sf_dir, "embeddings")
    pick = lambda names, e: F.element_at(F.array(*[F.lit(n) for n in names]), (e + 1).cast("int"))
    i, k = F.col("vec_id"), F.col("label")
    return v.select(
        "vec_id", F.concat(F.lit("C"), F.substring(F.sha2(i.cast("string"), 256), 1, 10)).alias("id"), F.concat(F.lit("Topic "), k.cast("string"), F.lit(" part "), i.cast("string")).alias("name"),
        F.array(F.concat(F.lit("About topic "), k.cast("string"))).alias("description"), F.concat(F.lit("Content of "), i.cast("string")).alias("content"),
        F.array(F.concat(F.lit("pattern_"), k.cast("string")), F.concat(F.lit("parity_"), (i % 2).cast("string")), F.concat(F.lit("mod_"), (i % 7).cast("string"))).alias("patterns"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.struct(F.concat(F.lit("doc_"), ((i * 3 + j * j) % 97).cast("string")).alias("doc_id"), F.concat(F.lit("/corpus/src"), ((i + j) % 20).cast("string"), F.lit("/en/doc_"), (i + j).cast("string"), F.lit(".txt")).alias("file"), ((i + j) % 3 != 0).alias("is_found"))).alias("evidences"),
        F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: F.struct((i + j).alias("target"), (F.lit(1.0) / (j + k % 3)).alias("weight"), F.lit("near").alias("source"))).alias("related_clusters"),
        F.when(i % 11 == 0, None).otherwise((i * 37 % 101) / 100.0).alias("confidence"), F.when(i % 13 == 0, None).otherwise((i * 53 % 89) / 88.0).alias("hotness"),
        pick(LIFECYCLES[:3], i % 3).alias("lifecycle"), pick(LEVELS[:4], k % 4).alias("abstraction_level"), (i % 5 + 1).cast("int").alias("version"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(vec_id % 1200 as int))").alias("create_time"),
        F.when(i % 17 != 0, F.col("embedding")).alias("embedding_vector"),
        F.transform(F.sequence(F.lit(0), (i % 6).cast("int")), lambda j: F.concat(F.lit("query "), j.cast("string"))).alias("queries"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, turn, role, content, ts)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("content"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(cast(conv_id % 60 as int), cast(conv_id % 24 as int), cast(turn as int))").alias("ts"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, title, created_at, updated_at, message_count)."""
    m = messages(spark, sf_dir)
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn")))
    return m.groupBy("session_id").agg(F.substring(F.coalesce(first, F.lit("")), 1, 50).alias("title"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("message_count"))


def llm_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, model, prompt_tokens, completion_tokens)."""
    return table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("model"), F.floor("value").cast("bigint").alias("prompt_tokens"), (F.col("user_id") % 97).cast("bigint").alias("completion_tokens"))


_CORPUS = """corpus AS (
  SELECT doc_id, '/corpus/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt' AS filename, 'txt' AS extension,
         coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, n_chars AS size_bytes, coalesce(text, '') AS content FROM documents)"""
_LINES = """parts AS (SELECT doc_id, path, string_split(content, chr(10)) AS p FROM corpus),
whole AS (SELECT doc_id, path, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts),
lines AS (SELECT doc_id, path, CAST(unnest(generate_series(1, len(p))) AS INTEGER) AS line_number, unnest(p) AS line FROM whole)"""
_CLUSTERS = """clusters AS (
  SELECT vec_id, label, 'C' || sha256(CAST(vec_id AS VARCHAR))[1:10] AS id, 'Topic ' || label || ' part ' || vec_id AS name, ['About topic ' || label] AS description, 'Content of ' || vec_id AS content,
         ['pattern_' || label, 'parity_' || (vec_id % 2), 'mod_' || (vec_id % 7)] AS patterns,
         CASE WHEN vec_id % 11 = 0 THEN NULL ELSE (vec_id * 37 % 101) / 100.0::DOUBLE END AS confidence, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE (vec_id * 53 % 89) / 88.0::DOUBLE END AS hotness,
         ['STABLE', 'EMERGING', 'CONTESTED'][vec_id % 3 + 1] AS lifecycle, ['TECHNIQUE', 'PRINCIPLE', 'PARADIGM', 'FOUNDATION'][label % 4 + 1] AS abstraction_level, CAST(vec_id % 5 + 1 AS INTEGER) AS version,
         TIMESTAMP '2024-01-01' + to_hours(CAST(vec_id % 1200 AS INTEGER)) AS create_time, CASE WHEN vec_id % 17 <> 0 THEN embedding END AS embedding_vector,
         list_transform(range(0, vec_id % 6 + 1), lambda j: 'query ' || j) AS queries FROM embeddings),
evidence AS (SELECT vec_id, id, j, 'doc_' || ((vec_id * 3 + j * j) % 97) AS doc_id, '/corpus/src' || ((vec_id + j) % 20) || '/en/doc_' || (vec_id + j) || '.txt' AS file, (vec_id + j) % 3 <> 0 AS is_found FROM clusters, range(0, 5) t(j)),
edges AS (SELECT vec_id, id, vec_id + j AS target, 1.0::DOUBLE / (j + label % 3) AS weight, 'near' AS source, j FROM clusters, range(1, 4) t(j))"""
_MESSAGES = """messages AS (
  SELECT conv_id AS session_id, turn, role, coalesce(text, '') AS content, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 60 AS INTEGER)) + to_hours(CAST(conv_id % 24 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS ts
  FROM conversations),
sessions AS (
  SELECT session_id, coalesce(min_by(content, turn) FILTER (role = 'user'), '')[1:50] AS title, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS message_count FROM messages GROUP BY session_id)"""
_USAGE = """llm_usage AS (SELECT ts, event_type AS model, CAST(floor(value) AS BIGINT) AS prompt_tokens, user_id % 97 AS completion_tokens FROM events)"""

SQL = {"corpus": _CORPUS, "lines": f"{_CORPUS},\n{_LINES}", "clusters": _CLUSTERS, "messages": _MESSAGES, "llm_usage": _USAGE}
