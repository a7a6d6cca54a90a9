"""Tables on disk: versioned Parquet snapshots behind a pointer file, CSV and Parquet import and export, JSON stores."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer was faster."""


class SnapshotStore:
    """A table of which every version is a Parquet folder; the file of a number in ``versions`` names it.

    A write goes into a new folder; then the file of the next number is moved to its place, which fails if there is one.
    So a reader sees whole versions, a failed write changes nothing, and of two writers of one number one has to try
    again. ``expect`` makes a write fail if the version isn't the one it was made from. All files go through Hadoop's file
    system, so a store may lie wherever Spark can write.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._fs.mkdirs(self._path("versions"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @property
    def _fs(self):
        return self._path("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    @property
    def version(self) -> int:
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(self._path("versions")) if s.getPath().getName().isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an empty table before the first."""
        n = self.version if version is None else version
        if n == 0:
            return self.spark.createDataFrame([], self.schema)
        folder = self.spark.read.text(f"{self.root}/versions/{n}").first().value
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}")

    def write(self, df: DataFrame, expect: int | None = None) -> int:
        now = self.version
        if expect is not None and expect != now:
            raise Conflict(f"version {now} isn't {expect}")
        folder = uuid.uuid4().hex
        df.select(*self.schema.fieldNames()).write.parquet(f"{self.root}/{folder}")
        part = self._path(f"_{folder}")
        out = self._fs.create(part)
        out.write(folder.encode())
        out.close()
        while not self._move(part, self._path(f"versions/{now + 1}")):
            if expect is not None:
                self._fs.delete(part, False)
                self._fs.delete(self._path(folder), True)
                raise Conflict(f"version {now + 1} is there already")
            now += 1
        return now + 1

    def _move(self, source, target) -> bool:
        """Whether the file could be moved: not if the target is there."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True


def export_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.csv(path, header=True, sep=delimiter)


def import_csv(spark: SparkSession, path: str, delimiter: str = ",", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", delimiter)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def export_tables(tables: dict[str, DataFrame], root: str) -> None:
    """One Parquet folder a table: a backup."""
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")


def import_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.isDirectory())
    return {name: spark.read.parquet(f"{root}/{name}") for name in found}


def append_to(df: DataFrame, table: str) -> None:
    """Rows to a table by the names of its columns; a table that isn't there is made from them."""
    if df.sparkSession.catalog.tableExists(table):
        df.select(*df.sparkSession.table(table).columns).write.insertInto(table)
    else:
        df.write.saveAsTable(table)


def create_table(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'`{c}` {t}' for c, t in columns.items())}) USING parquet")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def describe(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema]


def query(spark: SparkSession, text: str, **values) -> DataFrame:
    """A query with named parameters (``:name``)."""
    return spark.sql(text, args=values)


def binary_listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, filename, size_bytes, modified_at) of all files below ``root``; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = F.regexp_replace("path", "^file:/*", "/")
    return reader.load(root).select(path.alias("path"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) with bytes that aren't UTF-8 replaced; HTML without its tags."""
    from fossick.functions.text import extension, html_text

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.when(extension(F.col("path")).isin("html", "htm"), html_text(text)).otherwise(text).alias("content"))


def env_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): comments and blank lines left out, split at the first ``=``, quotes around the value gone."""
    t = spark.read.text(path).where("trim(value) <> '' AND NOT trim(value) LIKE '#%' AND value LIKE '%=%'")
    parts = F.split("value", "=", 2)
    return t.select(F.trim(parts[0]).alias("key"), F.regexp_replace(F.trim(parts[1]), r"""^(["'])(.*)\1$""", "$2").alias("value"))


def cached_contexts(spark: SparkSession, root: str, now: str, hours: float = 72.0) -> DataFrame:
    """Entries of a JSON cache (search_path, cached_at, summary) that aren't older than ``hours``."""
    t = spark.read.schema("search_path string, cached_at timestamp_ntz, summary string").json(root)
    return t.where(F.col("cached_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600})"))


def split_script(text: str) -> list[str]:
    """Statements of an SQL script: semicolons in quotes and comments don't end one."""
    parts = re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^;'\"`/-]+|.", text, re.S)
    out, now = [], ""
    for p in parts:
        if p == ";":
            out.append(now)
            now = ""
        elif not p.startswith(("--", "/*")):
            now += p
    return [s.strip() for s in [*out, now] if s.strip()]


def run_script(spark: SparkSession, text: str) -> DataFrame | None:
    """Runs all statements; the last one's result."""
    last = None
    for s in split_script(text):
        last = spark.sql(s)
    return last
