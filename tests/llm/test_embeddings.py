import numpy as np
import pytest
from pyspark.sql import types as T

from fossick.llm import embeddings as E
from fossick.llm.components import roots

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("node", T.StringType()), T.StructField("cell", T.StringType())])


def brute(ids, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(x @ x.T >= E.COSINE)
    r = roots(i, j, len(x))
    least = {}
    for g, v in zip(r, ids, strict=True):
        least[g] = min(least.get(g, v), v)
    return {(v, least[g]) for g, v in zip(r, ids, strict=True) if least[g] != v}


def clusters(rng, singles, groups, spread):
    """Single vectors, and groups of the given sizes around a vector each."""
    out = [rng.standard_normal((singles, E.DIM))]
    for n in groups:
        c = rng.standard_normal(E.DIM)
        out.append(c / np.linalg.norm(c) + spread * rng.standard_normal((n, E.DIM)) / np.sqrt(E.DIM))
    x = np.concatenate(out)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("spread", [0.05, 0.15, 0.2])
def test_recall_and_precision(spark, spread):
    rng = np.random.default_rng(4)
    x = clusters(rng, 1500, [2] * 300 + [5] * 40 + [400], spread)
    ids = list(range(len(x)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, v.tolist(), "x", "x") for i, v in zip(ids, x, strict=True)], SCHEMA)
    got, want = {tuple(r) for r in E.near_duplicates(df).collect()}, brute(ids, x)
    assert {a for a, _ in got} <= {a for a, _ in want}
    assert len(got & want) >= 0.95 * len(want)


def test_driver_table_with_planted_copies(spark):
    """The driver's vectors have no near copies; some are planted, exact and near ones, and one that isn't near enough."""
    rng = np.random.default_rng(8)
    rows = [(r.vec_id, np.array(r.embedding, np.float32)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert not brute([i for i, _ in rows], np.stack([v for _, v in rows]))
    for k, (i, v) in enumerate(rows[:120]):
        d = rng.standard_normal(E.DIM)
        rows.append((10_000 + i, (v + (0, 0.1, 0.25, 0.5)[k % 4] * d / np.linalg.norm(d)).astype(np.float32)))
    want = brute([i for i, _ in rows], np.stack([v for _, v in rows]))
    df = spark.createDataFrame([(i, v.tolist(), None, None) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in E.near_duplicates(df).collect()}
    assert {a for a, _ in got} <= {a for a, _ in want} and len(got & want) >= 0.95 * len(want) and len(want) >= 90


def test_visits_reach_the_recall(spark):
    rng = np.random.default_rng(5)
    x = clusters(rng, 4000, [], 0)
    y = x + np.sqrt(2 - 2 * E.COSINE) * (d := rng.standard_normal(x.shape)) / np.linalg.norm(d, axis=1, keepdims=True)
    half = E.DIM // 2
    books = np.stack([x[:64, :half], x[:64, half:]])
    row, cell = E.visits(x, books)
    home = E._distances(y[:, :half], books[0]).argmin(1) * 64 + E._distances(y[:, half:], books[1]).argmin(1)
    # a row's cells come in the order of the sum of both distances, each once
    far = E._distances(x[:, :half], books[0])[row, cell // 64] + E._distances(x[:, half:], books[1])[row, cell % 64]
    same = row[1:] == row[:-1]
    assert (np.diff(row) >= 0).all() and (far[1:] >= far[:-1] - 1e-4)[same].all() and len(np.unique(row * 4096 + cell)) == len(row)
    reached = np.zeros(len(x), bool)
    np.logical_or.at(reached, row, cell == home[row])
    assert reached.mean() >= 0.9


def test_messy(spark):
    a = [1.0] + [0.0] * 63
    b = [0.0, 1.0] + [0.0] * 62
    rows = [(1, a), (1, a), (2, [x * 3 for x in a]), (None, a), (3, None), (4, []), (5, a[:10]), (6, [0.0] * 64), (7, [None, *a[1:]]), (8, [float("nan"), *a[1:]]), (9, [float("inf"), *a[1:]]), (10, b), (11, [-0.0 if x == 0 else x for x in b])]
    df = spark.createDataFrame([(i, v, None, "x") for i, v in rows], SCHEMA)
    got = sorted(map(tuple, E.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 1), (11, 10)], key=str)
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert E.near_duplicates(df.where("vec_id = 10")).count() == 0


def test_long_cells_agree_with_short_ones():
    rng = np.random.default_rng(6)
    x = clusters(rng, 200, [700, 500, 3, 2], 0.12)
    code, scale, err = E.codes(x)
    q = code.astype(np.float32) * scale[:, None]
    home = rng.random(len(x)) < 0.8
    parts = []
    for f in (E._short_cell, E._long_cell):
        sure, maybe = f(q, err, home, E.COSINE)
        cos = (x[maybe[:, 0]] * x[maybe[:, 1]]).sum(1)
        e = np.concatenate([sure, maybe[cos >= E.COSINE]])
        assert ((x[sure[:, 0]] * x[sure[:, 1]]).sum(1) >= E.COSINE - 1e-6).all()
        parts.append(roots(e[:, 0], e[:, 1], len(x)))
    a, b = parts
    assert len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))
