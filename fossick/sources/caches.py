"""JSON stores of what scans and searches learnt: file metadata, contexts of search paths, manifests of uploads, audits.

A store is a folder of JSON lines; each write adds a part, and the newest entry of a key counts. So writers don't meet,
and a reader sees whole parts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METADATA = "cache_key string, path string, size_bytes bigint, modified_at timestamp_ntz, mime string, title string, keywords array<string>, saved_at timestamp_ntz"
CONTEXT = "search_path string, cached_at timestamp_ntz, summary string, files array<struct<filename:string,title:string,keywords:array<string>,preview:string>>"
MANIFEST = "file_id string, collection string, name string, size_bytes bigint, sha256 string, upload_time timestamp_ntz, gone boolean"
AUDIT = "ts timestamp_ntz, client_ip string, action string, path string, result string"


def _load(spark: SparkSession, root: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(root)


def _newest(df: DataFrame, key: str, at: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(at))
    return df.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cache_key(path, modified_at, size):
    """A file as it was: its path, time and size."""
    return F.md5(F.concat_ws("|", path, F.date_format(modified_at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), size.cast("string")).cast("binary"))


def save_metadata(files: DataFrame, root: str, now: str) -> None:
    """Adds files (path, size_bytes, modified_at, mime, title, keywords)."""
    key = cache_key(F.col("path"), F.col("modified_at"), F.col("size_bytes"))
    files.select(key.alias("cache_key"), "path", "size_bytes", "modified_at", "mime", "title", "keywords", F.lit(now).cast("timestamp_ntz").alias("saved_at")).write.mode("append").json(root)


def load_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The newest entry of every path; broken lines have no path and drop out."""
    return _newest(_load(spark, root, METADATA), "path", "saved_at")


def save_context(spark: SparkSession, root: str, paths: list[str], summary: str, scanned: DataFrame, now: str, *, most: int = 50) -> None:
    """Adds a context for each search path: the summary and up to ``most`` of the scanned candidates (path, title,
    keywords, preview) at or below it."""
    sp = spark.createDataFrame([(p.rstrip("/"),) for p in dict.fromkeys(paths)], "search_path string")
    inside = (F.col("path") == F.col("search_path")) | F.col("path").startswith(F.concat(F.col("search_path"), F.lit("/")))
    found = scanned.join(F.broadcast(sp), inside).withColumn("_r", F.row_number().over(Window.partitionBy("search_path").orderBy("path"))).where(F.col("_r") <= most)
    entry = F.struct(F.element_at(F.split("path", "/"), -1).alias("filename"), "title", "keywords", F.substring("preview", 1, 500).alias("preview"))
    files = found.groupBy("search_path").agg(F.array_sort(F.collect_list(entry)).alias("files"))
    sp.join(files, "search_path", "left").select("search_path", F.lit(now).cast("timestamp_ntz").alias("cached_at"), F.lit(summary).alias("summary"), "files").write.mode("append").json(root)


def load_context(spark: SparkSession, root: str, paths: list[str], now: str, *, hours: float = 72.0) -> str:
    """The newest contexts of the search paths, those of more than ``hours`` ago left out, as one text in their order."""
    wanted = [p.rstrip("/") for p in dict.fromkeys(paths)]
    fresh = _newest(_load(spark, root, CONTEXT), "search_path", "cached_at").where(F.col("search_path").isin(wanted))
    fresh = fresh.where(F.col("cached_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600})"))
    tag = lambda label, x: F.when(F.coalesce(F.length(x), F.lit(0)) > 0, F.concat(F.lit(f"  [{label}: "), x, F.lit("]"))).otherwise("")
    line = lambda f: F.concat(
        F.lit("  - "), F.coalesce(f["filename"], F.lit("?")), tag("title", f["title"]), tag("keywords", F.array_join(F.slice(f["keywords"], 1, 5), ", ")),
        F.when(F.coalesce(F.length(f["preview"]), F.lit(0)) > 0, F.concat(F.lit("\n    preview: "), F.substring(f["preview"], 1, 200))).otherwise(""),
    )
    known = F.when(F.size("files") > 0, F.concat(F.lit("\nKnown files:\n"), F.array_join(F.transform("files", line), "\n"))).otherwise("")
    text = {r.search_path: r.t for r in fresh.select("search_path", F.concat(F.coalesce("summary", F.lit("")), known).alias("t")).collect()}  # one row a path that was asked for
    return "\n\n".join(f"[{p}]\n{text[p]}" for p in wanted if text.get(p))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The files that are there, each as its newest entry says."""
    return _newest(_load(spark, root, MANIFEST), "file_id", "upload_time").where("NOT coalesce(gone, false)").drop("gone")


def add_files(files: DataFrame, root: str) -> None:
    """Adds files (file_id, collection, name, size_bytes, sha256, upload_time)."""
    files.select("file_id", "collection", "name", "size_bytes", "sha256", "upload_time", F.lit(False).alias("gone")).write.mode("append").json(root)


def _mark_gone(gone: DataFrame, root: str, now: str) -> int:
    rows = gone.withColumn("upload_time", F.lit(now).cast("timestamp_ntz")).withColumn("gone", F.lit(True))
    n = rows.count()
    if n:
        rows.write.mode("append").json(root)
    return n


def delete_file(spark: SparkSession, root: str, file_id: str, now: str) -> bool:
    """Whether there was such a file."""
    return _mark_gone(manifest(spark, root).where(F.col("file_id") == file_id), root, now) > 0


def delete_collection(spark: SparkSession, root: str, collection: str, now: str) -> int:
    """The number of files that went."""
    return _mark_gone(manifest(spark, root).where(F.col("collection") == collection), root, now)


def collections(files: DataFrame) -> DataFrame:
    """(collection, file_count, total_bytes, newest) of a manifest."""
    return files.groupBy("collection").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"), F.max("upload_time").alias("newest"))


def audit(events: DataFrame, root: str) -> None:
    """Adds events (ts, client_ip, action, path, result); for a stream hand this to ``streams.write_each``."""
    events.select("ts", "client_ip", "action", "path", "result").write.mode("append").json(root)


def read_audit(spark: SparkSession, root: str) -> DataFrame:
    return _load(spark, root, AUDIT)
