from collections import Counter

import duckdb

from fossick.llm import mixing as M
from fossick.llm.queries import op6_source_mixing

DATA = "/root/testdata/sf0.01"
COLUMNS = ("slot", "source", "epoch", "block", "doc_id", "from_token", "n_tokens")


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({M.schedule_sql()})").fetchall())
    assert Counter(tuple(r) for r in op6_source_mixing(spark, DATA).select(*COLUMNS).collect()) == want


def test_shares_of_every_prefix(make):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    weights = {"a": 5, "b": 3, "c": 2}
    plan = M.schedule(make(rows), weights=weights, block=50)
    source = {r.slot: r.source for r in plan.select("slot", "source").distinct().collect()}
    assert sorted(source) == list(range(len(source)))
    seen = Counter()
    for k in range(len(source)):
        seen[source[k]] += 1
        for s, w in weights.items():
            assert abs(seen[s] - (k + 1) * w / 10) <= 3
    rows = plan.collect()
    per = Counter()
    for r in rows:
        per[r.slot] += r.n_tokens
    assert set(per.values()) == {50}
    # every document whole in every epoch
    assert {(r.doc_id) for r in rows} == set(range(3000))
    whole = Counter()
    for r in rows:
        if r.epoch == 0:
            whole[r.doc_id] += r.n_tokens
    assert set(whole.values()) == {10}


def test_every_source_has_a_point(spark):
    sums = spark.createDataFrame([(s, "0", t, 0) for s, t in (("a", 1), ("b", 10**12), ("c", 3), ("d", 10**12), ("e", 1))], "source string, range string, t bigint, ahead bigint")
    for weights in (None, {"a": 1, "b": 1 << 45, "c": 1, "d": 1 << 45, "e": 1}):
        rows = sorted(((r.lo, r.hi, r.source) for r in M.source_shares(sums, weights, 64).collect()))
        assert [s for _, _, s in rows] == list("abcde") and rows[0][0] == 0 and rows[-1][1] == 1 << 32
        assert all(lo < hi for lo, hi, _ in rows) and all(a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_small_sources_do_not_prolong_the_schedule(make):
    rows = [(i, "w " * 640, "big") for i in range(100)] + [(1000 + k, "w w w", f"s{k:02}") for k in range(20)]
    got = M.schedule(make(rows), block=640).select("slot", "source", "block").distinct().collect()
    assert {r.source for r in got} == {"big", *(f"s{k:02}" for k in range(20))}
    assert len({r.block for r in got if r.source == "big"}) == 100 and len({r.slot for r in got}) <= 200


def test_long_documents_are_cut(make):
    rows = [(1, "w " * 1000, "a"), (2, "w " * 5, "a")]
    got = M.schedule(make(rows), block=64).where("epoch = 0").collect()
    spans = sorted((r.from_token, r.n_tokens) for r in got if r.doc_id == 1)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) == 1000


def test_documents_as_mixed(messy, nothing, make):
    docs, rows = messy
    got = M.apply_schedule(docs, block=100)
    assert got.columns == docs.columns
    have, want = Counter((r.doc_id, r.text, r.source) for r in got.collect()), Counter(rows)
    assert set(have) == set(want) and all(have[k] >= n for k, n in want.items())
    assert M.apply_schedule(nothing).count() == M.schedule(nothing).count() == 0
    assert {r.doc_id for r in M.schedule(docs, block=100).collect()} == {i for i, _, _ in rows}
    assert M.schedule(docs, weights={"q": 1}).select("source").distinct().collect()[0].source == "q"


def test_documents_agree_with_schedule(make):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 5 == 0]) for i in range(500)]
    docs = make(rows)
    first = Counter((r.doc_id) for r in M.schedule(docs, block=40).where("from_token = 0").collect())
    assert Counter(r.doc_id for r in M.apply_schedule(docs, block=40).collect()) == first
