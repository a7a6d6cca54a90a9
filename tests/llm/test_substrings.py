import random
from collections import defaultdict

from fossick.llm import substrings as S
from tests.llm.conftest import words

DATA = "/root/testdata/sf0.001"


def brute(rows):
    """Spans of (id, text) by comparing all windows of all documents."""
    rows = {(i, t) for i, t in rows if t is not None}
    at, where = {}, defaultdict(set)
    for i, t in rows:
        spans, k, n = [], 0, len(t)
        while k < n:
            if t[k] in " \t\n\r\x0b\x0c":
                k += 1
                continue
            e = k
            while e < n and t[e] not in " \t\n\r\x0b\x0c":
                e += 1
            spans.append((k, e))
            k = e
        at[i, t] = spans
        for j in range(len(spans) - S.LEAST + 1):
            where[tuple(t[a:b] for a, b in spans[j : j + S.LEAST])].add((i, t, j))
    hits = defaultdict(dict)
    for places in where.values():
        docs = {(i, t) for i, t, _ in places}
        if len(docs) > 1:
            for i, t, j in places:
                hits[i, t][j] = len(docs)
    out = []
    for (i, t), js in hits.items():
        spans = at[i, t]
        now = None
        for j in sorted(js):
            s, e = spans[j][0], spans[j + S.LEAST - 1][1]
            if now and s <= now[1]:
                now[1], now[2], now[3] = max(now[1], e), now[2] + 1, max(now[3], js[j])
            else:
                now = [s, e, 1, js[j]]
                out.append((i, now))
    return sorted((i if i is not None else -1, *x) for i, x in out)


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.end, r.windows, r.docs) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert want
    assert found(S.repeated_passages(docs)) == want


def test_passages_at_every_offset(make):
    rng = random.Random(3)
    shared = words(rng, 50)
    rows = [(k, f"{words(rng, k)} {shared} {words(rng, 7)}", "s") for k in range(40)]
    rows += [(100, words(rng, 20) + " " + " ".join(shared.split()[:49]) + " " + words(rng, 20), "s")]
    docs = make(rows)
    got = found(S.repeated_passages(docs))
    assert got == brute([(i, t) for i, t, _ in rows])
    assert {g[0] for g in got} == set(range(40))
    for i, s, e, n, d in got:
        assert dict((a, b) for a, b, _ in rows)[i][s:e] == shared and (n, d) == (1, 40)


def test_messy_and_empty(messy, nothing):
    docs, rows = messy
    assert found(S.repeated_passages(docs)) == brute([(i, t) for i, t, _ in rows])
    assert S.repeated_passages(nothing).count() == 0


def test_cover_is_a_difference_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
