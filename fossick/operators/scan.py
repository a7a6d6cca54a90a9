"""Directory scans: which files they take, metadata of the candidates, documents to analyse whole, and the files that a
ranking model means by the paths it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fossick.functions import text as X
from fossick.functions.matching import depth

#: Names of files and folders that no scan enters.
EXCLUDED = ("__pycache__", "node_modules", "Thumbs.db")
EXCLUDED_SUFFIXES = (".egg-info",)
TEXT = ("txt", "md", "rst", "log", "csv", "tsv", "py", "js", "ts", "json", "yaml", "yml", "xml", "toml", "cfg", "ini", "conf", "sh", "bash", "html", "htm", "css")
OFFICE = ("pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt")
#: Kinds that are analysed whole.
DOCUMENTS = ("pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "txt", "md", "rst", "csv", "tsv", "json", "yaml", "yml", "xml", "html", "htm", "log")
RELEVANCE = ("high", "medium", "low")


def walk(files: DataFrame, root: str, *, max_depth: int = 8, max_files: int | None = None, extensions: tuple[str, ...] = TEXT + OFFICE, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files below ``root`` in a walk that goes by name and stops after ``max_files``.

    Left out are hidden names, the names of ``EXCLUDED`` and ``exclude`` anywhere in the path, folders deeper than
    ``max_depth`` and other extensions. A walk sees a folder's entries in the order of their names, which is the order of
    the lists of a path's parts.
    """
    below = F.substring("path", len(root.rstrip("/")) + 2, 1_000_000)
    parts = F.split(below, "/")
    bad = F.exists(parts, lambda x: x.startswith(".") | x.isin(*EXCLUDED, *exclude) | F.coalesce(*[F.when(x.endswith(s), True) for s in EXCLUDED_SUFFIXES], F.lit(False)))
    out = files.where(F.col("path").startswith(root.rstrip("/") + "/") & ~bad & (depth(F.col("path"), root) <= max_depth + 1) & X.extension(F.col("path")).isin(*extensions))
    return out if max_files is None else out.withColumn("_parts", parts).orderBy("_parts").limit(max_files).drop("_parts")


def documents(files: DataFrame, paths: list[str], *, max_bytes: int = 10 << 20, max_files: int = 5) -> DataFrame:
    """(path, size_bytes, extension, is_text) of files to analyse whole, the smallest first: for each path the file
    itself or what a folder holds directly, of a known kind, not empty and not too large; the first ``max_files`` in the
    order of ``paths``."""
    at = [F.when((F.col("path") == p) | (X.parent(F.col("path")) == p.rstrip("/")), F.lit(i)) for i, p in enumerate(paths)]
    kind = X.extension(F.col("path"))
    found = files.withColumn("_at", F.coalesce(*at, F.lit(None).cast("int")) if at else F.lit(None).cast("int")).where(F.col("_at").isNotNull() & kind.isin(*DOCUMENTS) & F.col("size_bytes").between(1, max_bytes))
    first = found.dropDuplicates(["path"]).orderBy("_at", "path").limit(max_files)
    return first.select("path", "size_bytes", kind.alias("extension"), kind.isin(*TEXT).alias("is_text")).orderBy("size_bytes", "path")


def candidates(files: DataFrame, *, preview: int = 800, small: int = 100 * 1024, max_bytes: int | None = None) -> DataFrame:
    """Files (path, size_bytes, content) with route, title, preview, keywords, line_count, mime and content_loaded.

    Route ``full``: all metadata, and the content if it is ``small``; ``head``, for texts above ``max_bytes``: title and
    preview alone; ``stat``, for anything else: size and kind.
    """
    kind, x = X.extension(F.col("path")), F.col("content")
    is_text = kind.isin(*TEXT)
    big = F.lit(False) if max_bytes is None else F.col("size_bytes") > max_bytes
    f = files.withColumn("route", F.when(is_text & ~big, "full").when(is_text, "head").otherwise("stat"))
    some, full = F.col("route") != "stat", F.col("route") == "full"
    nothing = F.array().cast("array<string>")
    return f.select(
        "path", kind.alias("extension"), "size_bytes", "route", F.when(some, X.title_line(x)).otherwise("").alias("title"), F.when(some, X.preview(x, preview)).otherwise("").alias("preview"),
        F.when(full, X.head_keywords(x)).otherwise(nothing).alias("keywords"), F.when(full, X.estimated_lines(x, F.col("size_bytes"))).otherwise(0).alias("line_count"), X.mime_type(F.col("path")).alias("mime"),
        (full & (F.col("size_bytes") <= small)).alias("content_loaded"),
    )


def summary(scanned: DataFrame) -> DataFrame:
    """One row on candidates: n_files, n_dirs, n_loaded, n_sampled, total_bytes."""
    return scanned.agg(
        F.count("*").alias("n_files"), F.count_distinct(X.parent(F.col("path"))).alias("n_dirs"), F.count_if("content_loaded").alias("n_loaded"), F.count_if(F.col("route") != "full").alias("n_sampled"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
    )


def sample(files: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` random files, the same ones for the same seed; only k rows of a task go on."""
    return files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(k)


def _plain(path: Column) -> Column:
    return F.btrim(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), F.lit("/"))


def resolve(named: DataFrame, files: DataFrame) -> DataFrame:
    """(pos, path): the file that each of the names (pos, named) means, by the first that holds: its path; a path that
    ends with it; the only file of its base name; a file whose name holds the base name of more than five characters or
    is held by it; the first file of its base name. Ties go to the first path. Names that mean none have no row.

    ``named`` is what one reply of a model lists: it is small, ``files`` needn't be.
    """
    n = named.select("pos", _plain(F.col("named")).alias("named")).where("named <> ''").withColumn("base", F.element_at(F.split("named", "/"), -1))
    f = files.select("path", _plain(F.col("path")).alias("plain")).withColumn("name", F.element_at(F.split("plain", "/"), -1))
    near = (F.length("base") > 5) & (F.col("name").contains(F.col("base")) | F.col("base").contains(F.col("name")))
    hit = f.join(n, (F.col("plain") == F.col("named")) | F.col("plain").endswith(F.concat(F.lit("/"), F.col("named"))) | (F.col("name") == F.col("base")) | near)
    same = F.count_if(F.col("name") == F.col("base")).over(Window.partitionBy("pos"))
    how = F.when(F.col("plain") == F.col("named"), 1).when(F.col("plain").endswith(F.concat(F.lit("/"), F.col("named"))), 2).when((F.col("name") == F.col("base")) & (F.col("same") == 1), 3).when(near, 4).otherwise(5)
    best = F.min(F.struct(F.col("how"), F.col("path"))).alias("best")
    return hit.withColumn("same", same).withColumn("how", how).groupBy("pos").agg(best).select("pos", F.col("best.path").alias("path"))


def ranked(reply: DataFrame, files: DataFrame) -> DataFrame:
    """(path, relevance, reason, place) of a reply's entries (pos, named, relevance, reason): each file once, at its first
    entry, high before medium before low; an unknown relevance is low."""
    level = F.when(F.col("relevance").isin(*RELEVANCE), F.col("relevance")).otherwise("low")
    found = reply.select("pos", level.alias("relevance"), F.coalesce("reason", F.lit("")).alias("reason")).join(resolve(reply, files), "pos")
    once = found.groupBy("path").agg(F.min(F.struct("pos", "relevance", "reason")).alias("e")).select("path", "e.*")
    order = F.array_position(F.array(*map(F.lit, RELEVANCE)), F.col("relevance"))
    return once.select("path", "relevance", "reason", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "pos")).alias("place"))


def reply_entries(reply: Column) -> Column:
    """array<struct<path, relevance, reason>> from the JSON list in a model's reply; null where there is none."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<struct<path:string,relevance:string,reason:string>>")


def accepted(found: DataFrame, *, medium: bool = False) -> DataFrame:
    """Ranked files of high relevance, or of medium too."""
    return found.where(F.col("relevance").isin(*RELEVANCE[: 1 + medium]))


def browse(entries: DataFrame, folder: str, *, hidden: bool = False) -> DataFrame:
    """(name, is_dir, place) of what a folder of files (path) holds directly: folders first, then by name without case."""
    root = folder.rstrip("/") + "/"
    rest = F.substring("path", len(root) + 1, 1_000_000)
    e = entries.where(F.col("path").startswith(root)).select(F.element_at(F.split(rest, "/"), 1).alias("name"), rest.contains("/").alias("is_dir"))
    e = e.groupBy("name").agg(F.max("is_dir").alias("is_dir"))
    if not hidden:
        e = e.where(~F.col("name").startswith("."))
    return e.select("name", "is_dir", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("is_dir"), F.lower("name"), "name")).alias("place"))
