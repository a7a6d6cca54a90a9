"""Substring dedup by difference-cover anchors: passages of at least ``LEAST`` words that occur in several documents.

``COVER`` is a perfect difference set modulo ``PERIOD``: for any two positions in two documents, among PERIOD steps in
a row there is one at which both stand on the cover. So windows of ``WINDOW`` = LEAST - PERIOD + 1 words need hashing at
cover positions only, a fifth of all, and any common passage of LEAST words shares an aligned anchor. Anchors that
occur in one document only drop out. Around each other anchor the passage is extended: every window of LEAST words that
holds it is hashed whole, and what occurs in several documents is a repeat. Overlapping repeats are one span.

A word is a maximal run without ASCII white space; passages are equal if their words are, whatever stands between them.
Hashes have 64 bits: of N windows about N / 2**64 are taken for a repeat wrongly.

Defined results: null, empty and short texts have no spans; rows of equal id and text count as one document, so a
repeated row isn't a repeat; rows with a null id count as documents by their texts; a document that repeats only
itself isn't reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fossick.llm import bytehash as H
from fossick.llm.common import BATCH_BYTES, bound_batches, col, slices, string_buffers
from fossick.llm.lines import _runs

LEAST, PERIOD = 50, 31
COVER = (1, 5, 11, 24, 25, 27)
WINDOW = LEAST - PERIOD + 1
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _words(text: pa.Array) -> tuple[np.ndarray, ...]:
    data, offs = string_buffers(text)
    s, e, at = H.word_spans(data, offs)
    return data, offs, s, e, at, H.word_hashes(data, s, e)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        *_, at, h = _words(b.column(1))
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(h)) - at[:-1][doc]
        pick = np.flatnonzero(_ON_COVER[place % PERIOD] & (place + WINDOW <= n[doc]))
        key = H.spans_hash(h, pick, pick + WINDOW)
        yield pa.record_batch([pa.array(key.view(np.int64)), b.column(0).take(pa.array(doc[pick])), pa.array(place[pick].astype(np.int32))], ["key", "row", "place"])


def _shared(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (key, row): which belong to keys of several rows, and the number of those."""
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    begin = np.flatnonzero(new_key)
    new = new_key.copy()
    new[1:] |= row[1:] != row[:-1]
    docs = np.repeat(np.add.reduceat(new.astype(np.int64), begin), np.diff(np.append(begin, len(key))))
    return docs > 1, docs


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, row, place in _runs(batches, 1 << 18):
        several, _ = _shared(key.to_numpy(), row.to_numpy())
        at = pa.array(np.flatnonzero(several))
        yield pa.record_batch([row.take(at), place.take(at)], ["row", "place"])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of at least LEAST words, compressed for their way through the shuffle."""
    c = zstandard.ZstdCompressor(level=3)
    for b in slices(batches, "text"):
        data, offs = string_buffers(b.column(1))
        at = H.word_spans(data, offs)[2]
        data = memoryview(data)
        long = np.flatnonzero(np.diff(at) >= LEAST)
        if len(long):
            yield pa.record_batch([b.column(0).take(pa.array(long)), pa.array([c.compress(data[offs[i] : offs[i + 1]]) for i in long], pa.binary())], ["row", "text"])


def _unsqueezed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows with the texts as they were, in batches of about ``most`` bytes of them."""
    d = zstandard.ZstdDecompressor()
    for b in batches:
        first, size, texts = 0, 0, []
        packed = b.column(1)
        for i in range(b.num_rows):
            texts.append(d.decompress(packed[i].as_buffer()))
            size += len(texts[-1])
            if size >= most or i == b.num_rows - 1:
                yield pa.record_batch([b.column(0).slice(first, len(texts)), pa.array(texts, pa.binary()).cast(pa.string()), b.column(2).slice(first, len(texts))], b.schema.names)
                first, size, texts = i + 1, 0, []


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of LEAST words that hold one of a document's anchors: hash, row, and span: the first character and, in
    the low 32 bits, the number of characters."""
    for b in _unsqueezed(batches, BATCH_BYTES):
        data, _, s, e, at, h = _words(b.column(1))
        n = np.diff(at)
        anchors = b.column(2)
        count = np.diff(anchors.offsets.to_numpy())
        place = anchors.flatten().to_numpy()
        doc = np.repeat(np.arange(len(n)), count)
        # +1 where the starts that an anchor allows begin, -1 behind them: starts with a positive sum are wanted
        lo, hi = np.maximum(0, place - (LEAST - WINDOW)), np.minimum(place, n[doc] - LEAST)
        good = hi >= lo
        step = np.zeros(len(h) + 1, np.int32)
        np.add.at(step, at[:-1][doc[good]] + lo[good], 1)
        np.add.at(step, at[:-1][doc[good]] + hi[good] + 1, -1)
        pick = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        own = np.searchsorted(at, pick, side="right") - 1
        key = H.spans_hash(h, pick, pick + LEAST, 1)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = chars[string_buffers(b.column(1))[1][:-1]][own]
        span = ((chars[s[pick]] - base) << 32) | (chars[e[pick + LEAST - 1]] - chars[s[pick]])
        yield pa.record_batch([pa.array(key.view(np.int64)), b.column(0).take(pa.array(own)), pa.array(span)], ["key", "row", "span"])


def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, row, span in _runs(batches, 1 << 18):
        several, docs = _shared(key.to_numpy(), row.to_numpy())
        at = pa.array(np.flatnonzero(several))
        yield pa.record_batch([row.take(at), span.take(at), pa.array(docs[several].astype(np.int32))], ["row", "span", "docs"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, windows, docs): spans of characters (end not included) that other documents hold too, the
    number of repeated windows in the span, and the most documents that share one of them.

    Shuffled are anchors (a fifth of the words), the texts of documents once and compressed, and the windows around
    shared anchors.
    """
    bound_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.xxhash64(col(id_col), col(text_col)).alias("row"), col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    anchors = src.mapInArrow(_anchors, "key bigint, row bigint, place int").repartition(n, "key").sortWithinPartitions("key", "row")
    shared = anchors.mapInArrow(_shared_anchors, "row bigint, place int").groupBy("row").agg(F.collect_list("place").alias("places"))
    held = src.mapInArrow(_squeezed, "row bigint, text binary").join(shared, "row").select("row", "text", "places")
    windows = held.mapInArrow(_windows, "key bigint, row bigint, span bigint").repartition(n, "key").sortWithinPartitions("key", "row")
    hits = windows.mapInArrow(_shared_windows, "row bigint, span bigint, docs int").repartition(n, "row")
    hits = hits.select("row", F.shiftright("span", 32).cast("int").alias("start"), (F.shiftright("span", 32) + F.col("span").bitwiseAND(0xFFFFFFFF)).cast("int").alias("end"), "docs")
    w = Window.partitionBy("row").orderBy("start", "end")
    island = F.coalesce((F.col("start") > F.lag(F.col("far")).over(w)).cast("int"), F.lit(1))
    far = hits.withColumn("far", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = far.withColumn("first", island).withColumn("island", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct("start").alias("windows"), F.max("docs").alias("docs"))
    ids = docs.select(F.xxhash64(col(id_col), col(text_col)).alias("row"), col(id_col).alias("doc_id")).distinct()
    return spans.join(ids, "row").select("doc_id", "start", "end", "windows", "docs")
