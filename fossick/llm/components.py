"""Connected components of an edge table by distributed union-find.

First every task joins the edges it holds in a local union-find and passes on stars only; then large-star and small-star
rounds run until nothing changes, each round written to the shared work folder. No step gathers a component in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossick.llm.common import remove_table, write_table

#: Edges that a task joins at once before it passes on their stars.
LOCAL_EDGES = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each node's component; nodes are 0..n-1. Vectorised hooking and pointer jumping."""
    p = np.arange(n)
    while True:
        ra, rb = p[a], p[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            return p
        np.minimum.at(p, hi, lo)
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        e = np.concatenate(held)
        nodes, at = np.unique(e, return_inverse=True)
        at = at.reshape(-1, 2)
        r = roots(at[:, 0], at[:, 1], len(nodes))
        far = r != np.arange(len(nodes))
        return pa.record_batch([pa.array(nodes[far]), pa.array(nodes[r[far]])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], 1))
            size += batch.num_rows
            if size >= LOCAL_EDGES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two bigint columns), root being the least node of its component.

    Loops, repeated edges and either direction are allowed; edges with a null are ignored; no edge gives no row.
    """
    a, b = edges.columns
    e = edges.select(F.col(f"`{a}`").cast("bigint").alias("a"), F.col(f"`{b}`").cast("bigint").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e, path = write_table(e.mapInArrow(_stars, "a bigint, b bigint").distinct())
    state = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        new, new_path = write_table(small)
        got = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("bigint"))).first()
        remove_table(e.sparkSession, path)
        e, path = new, new_path
        if tuple(got) == state:
            break
        state = tuple(got)
    self = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(self)
