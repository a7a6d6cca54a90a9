"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit.

Null texts have no length and are left out; an empty text has length 0. Rows count as often as they occur. An empty
table gives an empty histogram. Only the text column is read, so other columns may have any name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fossick.llm.common import bound_batches, col, slices, write_table

#: The public byte-level pattern: contractions, letters, numbers and other marks with a leading blank, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Lengths in one bucket of the two-level suffix sum.
BUCKET = 1024
#: Pieces whose counts a worker remembers before it starts afresh; only speed depends on it.
REMEMBERED = 1 << 19

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


class _Counts(dict):
    """Piece -> number of tokens, filled on demand."""

    def __init__(self, path: str):
        super().__init__()
        self.bpe = encoding(path)

    def __missing__(self, piece: str) -> int:
        n = len(self.bpe._encode_single_piece(piece))
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n
        return n


def count_tokens(texts: list[str], counts: _Counts) -> np.ndarray:
    """Tokens of each text. The pattern cuts a text into pieces that are encoded alone, so counts of pieces add up."""
    find, get = regex.compile(PATTERN).findall, counts.__getitem__
    return np.fromiter((sum(map(get, find(t))) for t in texts), np.int64, len(texts))


def token_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): partial counts of one batch each; not yet added up."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(path)
        for b in slices(batches, "text"):
            n, c = np.unique(count_tokens(b.column(0).drop_null().to_pylist(), counts), return_counts=True)
            yield pa.record_batch([pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["n_tokens", "n_docs"])

    return docs.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens bigint, n_docs bigint")


def length_histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One row for each encoded length: n_tokens, n_docs, and for a context limit of n_tokens

    * docs_within, tokens_within: documents of at most this length and their tokens;
    * docs_over, tokens_over: the rest, the suffix sums;
    * truncated_tokens: tokens left when every document is cut at this length;
    * quantile: the share of documents of at most this length.

    Texts are encoded once: the counts, a row for each length, are written before they are read twice. Only counts are
    shuffled. The sums run inside buckets of ``BUCKET`` lengths and over bucket totals, of which there
    are as many as the longest document has thousands of tokens.
    """
    hist, _ = write_table(token_lengths(docs, path, text_col).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))
    hist = hist.withColumn("bucket", F.expr(f"n_tokens div {BUCKET}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inside = Window.partitionBy("bucket").orderBy("n_tokens")
    hist = hist.select(
        "bucket", "n_tokens", "n_docs", F.sum("n_docs").over(inside).alias("d"), F.sum("tokens").over(inside).alias("t"),
        F.sum("n_docs").over(Window.partitionBy("bucket")).alias("bd"), F.sum("tokens").over(Window.partitionBy("bucket")).alias("bt"),
    )
    totals = hist.groupBy("bucket").agg(F.first("bd").alias("bd"), F.first("bt").alias("bt"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "bucket", F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"),
        F.sum("bd").over(every).alias("all_d"), F.sum("bt").over(every).alias("all_t"),
    )
    within_d, within_t = F.col("d0") + F.col("d"), F.col("t0") + F.col("t")
    return hist.join(totals, "bucket").select(
        "n_tokens", "n_docs", within_d.alias("docs_within"), within_t.alias("tokens_within"),
        (F.col("all_d") - within_d).alias("docs_over"), (F.col("all_t") - within_t).alias("tokens_over"),
        (within_t + F.col("n_tokens") * (F.col("all_d") - within_d)).alias("truncated_tokens"),
        (within_d / F.col("all_d")).alias("quantile"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_within, tokens_within, docs_over, truncated_tokens) for any limits, also between lengths."""
    rows = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit bigint")
    got = hist.select("n_tokens", "n_docs").join(F.broadcast(rows))
    fits = F.col("n_tokens") <= F.col("context_limit")
    size = F.col("n_tokens") * F.col("n_docs")
    return got.groupBy("context_limit").agg(
        F.sum(F.when(fits, F.col("n_docs")).otherwise(0)).alias("docs_within"), F.sum(F.when(fits, size).otherwise(0)).alias("tokens_within"),
        F.sum(F.when(fits, 0).otherwise(F.col("n_docs"))).alias("docs_over"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_tokens"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents doesn't exceed."""
    rows = hist.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return hist.join(F.broadcast(rows), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
