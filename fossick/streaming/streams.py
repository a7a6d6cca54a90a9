"""Streams: incremental files, running usage, event-time windows, snapshot sinks and an exact rate limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType


def table_stream(spark: SparkSession, folder: str, schema: StructType, *, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def new_files(spark: SparkSession, root: str, *, files_per_batch: int = 1000) -> DataFrame:
    """(path, modified_at, size_bytes, content) of files not seen before; the checkpoint remembers them."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    return raw.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), "content")


def running_usage(usage: DataFrame) -> DataFrame:
    """Calls and tokens of each model so far; for update or complete mode."""
    return usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def window_counts(events: DataFrame, *, every: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts and sums of events in tumbling or sliding windows, on a stream or a table."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_t", late)
    w = F.window("_t", every, slide) if slide else F.window("_t", every)
    return e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def session_counts(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_t", late)
    return e.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), "n")


def write_each(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, seconds: int | None = None, mode: str = "append") -> StreamingQuery:
    """Hands every batch to ``sink``; without ``seconds`` all there is, then it ends."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


class RateLimiter(StatefulProcessor):
    """Admits a hit if fewer than ``per_second`` hits of the last second and ``per_minute`` of the last minute were
    admitted; only admitted hits count. The state is the times of a minute."""

    def __init__(self, per_second: int = 5, per_minute: int = 100):
        self.per_second, self.per_minute = per_second, per_minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = list(self.times.get()[0]) if self.times.exists() else []
        for frame in rows:
            frame = frame.sort_values("ts")
            out = []
            for t in frame["ts"].astype("int64") / (1e9 if str(frame["ts"].dtype).startswith("datetime64[ns") else 1e6):
                kept = [x for x in kept if t - x < 60]
                ok = len(kept) < self.per_minute and sum(t - x < 1 for x in kept) < self.per_second
                if ok:
                    kept.append(t)
                out.append(ok)
            yield pd.DataFrame({"key": [str(key[0])] * len(out), "ts": frame["ts"].to_numpy(), "admitted": out})
        self.times.update((kept,))

    def close(self) -> None:
        pass


def rate_limited(hits: DataFrame, key: str, *, per_second: int = 5, per_minute: int = 100) -> DataFrame:
    """(key, ts, admitted) of a stream of hits (key, ts)."""
    t = hits.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return t.groupBy("key").transformWithStateInPandas(RateLimiter(per_second, per_minute), "key string, ts timestamp, admitted boolean", "append", "none")
