"""Embedding near-dedup by an inverted multi-index: independent codebooks on the two halves of a vector.

k-means over a sample (``TRAIN`` vectors a centroid, chosen by their hashes) gives each half ``k`` centroids; the pairs of
them are the cells of a product grid, in which every vector is indexed. A vector's home is the cell of its two nearest
centroids. As a query it visits cells in the order of the sum of its distances to both centroids, by a multi-sequence
traversal that takes the next of the two sorted lists' sums step by step, until the chance that a vector at exactly the wanted similarity lives in a
visited cell reaches ``RECALL``; since either vector of a pair may find the other, few pairs are missed. The chance
comes from the query's margins to the borders of the cells, for a difference in any direction; the lists of nearest
centroids grow until what lies beyond them can't matter. ``k`` grows as the root of the number of vectors, so a cell
holds about ``OCCUPANCY`` of them at every size.

Cells hold vectors as 64 bytes with a bound of the rounding error. A pair that the bound decides is decided; every other
pair is verified with the vectors themselves. Near copies are joined to groups by distributed union-find.

Defined results: vectors that are null, of another length than ``DIM``, with null or infinite parts or of length zero
take no part. Equal vectors are near copies. Of a group the row with the least vec_id stays (null last; of repeated rows
one). Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fossick.llm.common import bound_batches, col, remove_table, write_table
from fossick.llm.components import connected_components, roots
from fossick.llm.lines import _runs

DIM, COSINE, RECALL = 64, 0.95, 0.97
OCCUPANCY, ROUNDS = 32, 3
#: Vectors of the sample that the codebooks are fitted on, for each centroid.
TRAIN = 256
#: Rows of a cell that are compared all with all at once; longer ones go by ``_long_cell``.
WIDE = 1024


def _matrix(a: pa.Array, dim: int) -> np.ndarray:
    return a.flatten().to_numpy().reshape(-1, dim)


def _nodes(rows: DataFrame, dim: int) -> DataFrame:
    """(id, node, vec): the rows that take part, with unit vectors; equal vectors have the same node."""
    kind = rows.schema["id"].dataType.simpleString()
    good = rows.where((F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    scaled = good.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # no negative zeros: equal vectors have equal hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim)
                x = x / np.abs(x).max(1, keepdims=True)
                x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.reshape(-1)))], ["id", "vec"])

    unit = scaled.select("id", "vec").mapInArrow(run, f"id {kind}, vec array<float>")
    return unit.select("id", F.xxhash64("vec").alias("node"), "vec")


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0)


def train_codebooks(nodes: DataFrame, n: int, dim: int) -> np.ndarray:
    """(2, k, dim / 2) centroids after ``ROUNDS`` rounds of k-means over about ``TRAIN * k`` of ``n`` vectors.

    What comes to the driver is the codebooks, which grow as the root of ``n``. Sums travel as arrays, one a centroid and
    task, and are added up in tasks that hold a part of the centroids.
    """
    half = dim // 2
    k = 1 << max(1, ceil(log2(sqrt(max(4.0, n / OCCUPANCY)))))
    spark = nodes.sparkSession
    first = nodes.orderBy(F.xxhash64("node"), "node").limit(k).select("vec").collect()
    x = np.array([r[0] for r in first], np.float32)
    books = np.stack([x[:, :half], x[:, half:]])
    share = TRAIN * k / n
    sample, path = write_table(nodes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20)) < ceil(share * (1 << 20))).select("vec") if share < 1 else nodes.select("vec"))

    def rows(total: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        h, c = np.nonzero(count)
        s = total[h, c]
        return pa.record_batch([pa.array(h.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(count[h, c]), pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * half), pa.array(s.reshape(-1)))], ["h", "c", "n", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((2, k, half), np.float64), np.zeros((2, k), np.int64)
        for b in batches:
            h, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            np.add.at(total, (h, c), _matrix(b.column(3), half))
            np.add.at(count, (h, c), b.column(2).to_numpy())
        yield rows(total, count)

    kinds = "h int, c int, n bigint, s array<double>"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(ROUNDS):
        now = books

        def partial(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape, np.float64), np.zeros(now.shape[:2], np.int64)
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    v = _matrix(b.column(0).slice(i, 1024), dim)
                    for h in (0, 1):
                        part = v[:, h * half : (h + 1) * half]
                        own = _distances(part, now[h]).argmin(1)
                        np.add.at(total[h], own, part)
                        count[h] += np.bincount(own, minlength=now.shape[1])
            yield rows(total, count)

        got = sample.mapInArrow(partial, kinds).repartition(min(parts, max(1, k // 64)), "h", "c").mapInArrow(add, kinds).toArrow()
        books = now.copy()
        if got.num_rows:
            s = _matrix(got["s"].combine_chunks(), half)
            books[got["h"].to_numpy(), got["c"].to_numpy()] = s / got["n"].to_numpy()[:, None]
    remove_table(spark, path)
    return books


def _tail(z: np.ndarray) -> np.ndarray:
    """The chance that a normal number exceeds ``z`` >= 0; an approximation good to 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    return 0.3989422804 * np.exp(-z * z / 2) * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))


def nearest(x: np.ndarray, book: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroids of each row, their squared distances and the chance that a near copy lives there."""
    k = len(book)
    d = _distances(x, book)
    wide = min(8, k)
    while True:
        ids = np.argpartition(d, wide - 1, axis=1)[:, :wide] if wide < k else np.broadcast_to(np.arange(k), d.shape)
        dist = np.take_along_axis(d, ids, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        # a centroid beyond the list has a margin of at least this: its border is no nearer
        far = (np.sqrt(dist[:, -1]) - np.sqrt(dist[:, 0])) / (2 * sigma)
        if wide == k or (k * _tail(far) < 0.25 * (1 - RECALL)).all():
            break
        wide = min(k, 2 * wide)
    gap = np.sqrt(((book[ids] - book[ids[:, :1]]) ** 2).sum(-1))
    z = np.where(gap > 0, (dist - dist[:, :1]) / np.maximum(2 * sigma * gap, 1e-12), 0)
    chance = _tail(z)
    chance[:, 0] = 1 - chance[:, 1:2].sum(1)
    return ids, dist, chance / chance.sum(1, keepdims=True)


def visits(x: np.ndarray, books: np.ndarray, cosine: float = COSINE, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every visit, home first: cells in multi-sequence order until ``recall``."""
    half, k = x.shape[1] // 2, books.shape[1]
    sigma = sqrt((2 - 2 * cosine) / x.shape[1])
    (i, di, pi), (j, dj, pj) = (nearest(x[:, h * half : (h + 1) * half], books[h], sigma) for h in (0, 1))
    # a list position whose chance is nothing next to the target is of no use in any pair
    i, di, pi = (a[:, : max(1, int((pi > 1e-5).any(0).nonzero()[0].max(initial=0)) + 1)] for a in (i, di, pi))
    j, dj, pj = (a[:, : max(1, int((pj > 1e-5).any(0).nonzero()[0].max(initial=0)) + 1)] for a in (j, dj, pj))
    # every centroid of the first half has its next of the second; the least sum of all is the next cell of a row
    after = np.concatenate([dj, np.full((len(x), 1), np.inf, dj.dtype)], 1)
    at, cost, mass = np.zeros(di.shape, np.int64), di + dj[:, :1], np.zeros(len(x))
    live = np.arange(len(x))
    rows, cells = [], []
    while len(live):
        a = cost[live].argmin(1)
        b = at[live, a]
        chance = pi[live, a] * pj[live, b]
        some = chance > 0 if rows else np.ones(len(live), bool)
        rows.append(live[some])
        cells.append((i[live, a].astype(np.int64) * k + j[live, b])[some])
        mass[live] += chance
        at[live, a] = b + 1
        cost[live, a] = di[live, a] + after[live, b + 1]
        live = live[(mass[live] < recall) & np.isfinite(cost[live].min(1))]
    row, cell = np.concatenate(rows), np.concatenate(cells)
    order = np.argsort(row, kind="stable")
    return row[order], cell[order]


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each vector, their scale, and how far the rounded vector is from it."""
    scale = np.abs(x).max(1) / 127
    c = np.rint(x / scale[:, None]).astype(np.int8)
    return c, scale, np.sqrt(((x - c * scale[:, None]) ** 2).sum(1)).astype(np.float32)


def _emitter(books: np.ndarray, dim: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                x = _matrix(b.column(1).slice(i, 512), dim)
                row, cell = visits(x, books, cosine)
                code, scale, err = codes(x)
                home = np.concatenate([[True], row[1:] != row[:-1]])
                data = pa.py_buffer(np.ascontiguousarray(code[row]).tobytes())
                offs = pa.py_buffer((np.arange(len(row) + 1, dtype=np.int32) * dim).tobytes())
                yield pa.record_batch(
                    [pa.array(cell), b.column(0).slice(i, 512).take(pa.array(row)), pa.array(home), pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, offs, data]), pa.array(scale[row]), pa.array(err[row])],
                    ["cell", "node", "home", "code", "scale", "err"],
                )

    return run


def _judge(q: np.ndarray, err: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrices over ``i`` x ``j``: surely near, and maybe near."""
    s = q[i] @ q[j].T
    slack = err[i][:, None] + err[j][None, :] + err[i][:, None] * err[j][None, :] + 1e-5
    sure = s - slack >= cosine
    return sure, (s + slack >= cosine) & ~sure


def _short_cell(q: np.ndarray, err: np.ndarray, home: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    h = np.flatnonzero(home)
    sure, maybe = _judge(q, err, h, np.arange(len(q)), cosine)
    out = []
    for m in (sure, maybe):
        x, y = np.nonzero(m)
        e = np.stack([h[x], y], 1)
        out.append(e[e[:, 0] != e[:, 1]])
    return out[0], out[1]


def _long_cell(q: np.ndarray, err: np.ndarray, home: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a cell with many rows: rows with many others near them take those first, in one step each; blocks are
    then compared with what isn't linked to them yet, so a group of thousands costs about as much as its members."""
    sure_out, maybe_out = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    rest = np.arange(len(q))
    blocks: list[np.ndarray] = []
    for x in np.flatnonzero(home)[:: max(1, int(home.sum()) // 32)]:
        if x not in rest:
            continue
        hit = _judge(q, err, np.array([x]), rest, cosine)[0][0]
        if np.count_nonzero(hit) > max(1, len(rest) // 16):
            sure_out.append(np.stack([np.full(np.count_nonzero(hit), x), rest[hit]], 1))
            blocks.append(rest[hit])
            rest = rest[~hit]
    step = max(1, (1 << 22) // len(q))
    h = rest[home[rest]]
    every = np.concatenate([rest, *blocks])
    for k in range(0, len(h), step):
        for m, out in zip(_judge(q, err, h[k : k + step], every, cosine), (sure_out, maybe_out), strict=True):
            x, y = np.nonzero(m)
            out.append(np.stack([h[k + x], every[y]], 1))
    # visitors outside the blocks against the homes inside, and blocks against each other until they are linked
    guests = rest[~home[rest]]
    for n, block in enumerate(blocks):
        for other in [guests, *blocks[n + 1 :]]:
            whole = other is not guests
            done = False
            for k in range(0, len(block), step):
                part = block[k : k + step]
                for m, out, certain in zip(_judge(q, err, part, other, cosine), (sure_out, maybe_out), (True, False), strict=True):
                    x, y = np.nonzero(m & (home[part][:, None] | home[other][None, :]))
                    if len(x) and certain and whole:
                        x, y, done = x[:1], y[:1], True
                    elif certain:  # one partner in the block is enough for a guest
                        y, first = np.unique(y, return_index=True)
                        x = x[first]
                    out.append(np.stack([part[x], other[y]], 1))
                if done:
                    break
    return np.concatenate(sure_out), np.concatenate(maybe_out)


def link_cells(cell: np.ndarray, node: np.ndarray, home: np.ndarray, q: np.ndarray, err: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Sure edges (a spanning forest of them) and pairs to verify, of whole cells."""
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(begin, len(cell)))
    sure, maybe = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    several = (size > 1) & np.logical_or.reduceat(home, begin)
    for s, n in zip(begin[several], size[several], strict=True):
        part = slice(s, s + n)
        a, b = (_short_cell if n <= WIDE else _long_cell)(q[part], err[part], home[part], cosine)
        sure.append(a + s)
        maybe.append(b + s)
    r, m = np.concatenate(sure), np.concatenate(maybe)
    up = roots(r[:, 0], r[:, 1], len(node))
    far = np.flatnonzero(up != np.arange(len(node)))
    m = m[up[m[:, 0]] != up[m[:, 1]]]  # what is linked needs no verification
    m = np.sort(node[m], axis=1).reshape(-1, 2)
    return np.stack([node[far], node[up[far]]], 1), np.unique(m[m[:, 0] != m[:, 1]], axis=0)


def _linker(dim: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, node, home, code, scale, err in _runs(batches, 1 << 15):
            raw = np.frombuffer(code.buffers()[2], np.int8)[: (len(code) + code.offset) * dim].reshape(-1, dim)[code.offset :]
            q = raw.astype(np.float32) * scale.to_numpy()[:, None]
            sure, maybe = link_cells(cell.to_numpy(), node.to_numpy(), home.to_numpy(zero_copy_only=False), q, err.to_numpy(), cosine)
            a, b = np.ascontiguousarray(np.concatenate([sure, maybe]).T)
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < len(sure))], ["a", "b", "sure"])

    return run


def near_vectors(nodes: DataFrame, dim: int = DIM, cosine: float = COSINE) -> DataFrame:
    """(node, root) of all vectors (node, vec; written before) that have a near copy."""
    spark = nodes.sparkSession
    n = nodes.count()
    if n < 2:
        return spark.createDataFrame([], "node bigint, root bigint")
    books = train_codebooks(nodes, n, dim)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = nodes.select("node", "vec").mapInArrow(_emitter(books, dim, cosine), "cell bigint, node bigint, home boolean, code binary, scale float, err float")
    found, path = write_table(cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_linker(dim, cosine), "a bigint, b bigint, sure boolean"))
    open_ = found.where("NOT sure").select("a", "b").distinct()
    left, right = (nodes.select(F.col("node").alias(c), F.col("vec").alias(f"v{c}")) for c in "ab")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    good = open_.join(left, "a").join(right, "b").where(dot >= cosine).select("a", "b")
    out = connected_components(found.where("sure").select("a", "b").unionAll(good))
    remove_table(spark, path)
    return out


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, cosine: float = COSINE) -> DataFrame:
    """(vec_id, kept_id): every row that a near copy replaces, and the row that stays for its group.

    Vectors are written once and shuffled as bytes, once for each cell visited.
    """
    bound_batches(rows.sparkSession)
    src = rows.select(col(id_col).alias("id"), col(vec_col).cast("array<double>").alias("vec"))
    own, _ = write_table(_nodes(src, dim))
    nodes, path = write_table(own.groupBy("node").agg(F.first("vec").alias("vec")))
    found, _ = write_table(near_vectors(nodes, dim, cosine))
    remove_table(rows.sparkSession, path)
    groups = own.select("id", "node").join(found, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    w = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last())
    ranked = groups.select("id", F.row_number().over(w).alias("place"), F.first("id").over(w).alias("kept_id"))
    return ranked.where("place > 1").select(F.col("id").alias("vec_id"), "kept_id")
