"""Usage and health figures: model usage, storage, health score, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_by_model(usage: DataFrame) -> DataFrame:
    return usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), (F.sum("prompt_tokens") + F.sum("completion_tokens")).alias("total_tokens"))


def usage_per_minute(usage: DataFrame) -> DataFrame:
    """One row: calls, minutes between the first and the last call, calls a minute."""
    t = usage.agg(F.count("*").alias("calls"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6).alias("m"))
    return t.select("calls", F.round("m", 3).alias("minutes"), F.round(F.when(F.col("m") > 0, F.col("calls") / F.col("m")).otherwise(0.0), 6).alias("per_minute"))


def health_score(cpu: Column, memory: Column, disk: Column) -> Column:
    loss = F.when(cpu > 90, 30).when(cpu > 75, 15).otherwise(0) + F.when(memory > 90, 30).when(memory > 80, 15).otherwise(0) + F.when(disk > 95, 40).when(disk > 85, 20).otherwise(0)
    return F.greatest(F.lit(0), 100 - loss)


def health_band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")


def window_rates(hits: DataFrame, key: str, *, per_second: int = 5, per_minute: int = 100) -> DataFrame:
    """Hits (key, ts) with the numbers within the last second and minute, and whether both are within the limits.

    Counts all hits; the exact limiter, which counts admitted ones only, is ``streaming.streams.RateLimiter``.
    """
    t = hits.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy(key).orderBy("us")
    t = t.withColumn("in_second", F.count("*").over(w.rangeBetween(-999_999, 0))).withColumn("in_minute", F.count("*").over(w.rangeBetween(-59_999_999, 0)))
    return t.withColumn("within", (F.col("in_second") <= per_second) & (F.col("in_minute") <= per_minute)).drop("us")


def storage_by(files: DataFrame, key: str) -> DataFrame:
    """(key, file_count, total_bytes, mb)."""
    return files.groupBy(key).agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"), F.round(F.sum("size_bytes") / 1048576, 2).alias("mb"))


def disk_usage(files: DataFrame, limit_bytes: int) -> DataFrame:
    used = F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint")
    return files.agg(used.alias("used_bytes"), F.lit(limit_bytes).cast("bigint").alias("max_bytes"), F.round(used * 100.0 / limit_bytes, 2).alias("percent"))
