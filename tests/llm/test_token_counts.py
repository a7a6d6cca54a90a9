from collections import Counter

import pytest

from fossick.llm import token_counts as C
from fossick.llm.queries import BYTE_BPE, op1_token_counts

DATA = "/root/testdata/sf0.001"


def brute(texts):
    enc = C.encoding(BYTE_BPE)
    return Counter(len(enc.encode_ordinary(t)) for t in texts if t is not None)


def check(hist, want):
    rows = {r.n_tokens: r for r in hist.collect()}
    assert {n: r.n_docs for n, r in rows.items()} == dict(want)
    total, docs = sum(n * c for n, c in want.items()), sum(want.values())
    for n, r in rows.items():
        assert r.docs_within == sum(c for m, c in want.items() if m <= n)
        assert r.tokens_within == sum(m * c for m, c in want.items() if m <= n)
        assert (r.docs_over, r.tokens_over) == (docs - r.docs_within, total - r.tokens_within)
        assert r.truncated_tokens == sum(min(m, n) * c for m, c in want.items())
        assert r.quantile == pytest.approx(r.docs_within / docs)


def test_whole_table(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    check(op1_token_counts(spark, DATA), brute(texts))


def test_messy(messy):
    docs, rows = messy
    want = brute([t for _, t, _ in rows])
    hist = C.length_histogram(docs, BYTE_BPE)
    check(hist, want)
    got = {r.context_limit: r for r in C.at_limits(hist, [0, 100, 10**7]).collect()}
    for limit, r in got.items():
        assert r.docs_within == sum(c for n, c in want.items() if n <= limit)
        assert r.truncated_tokens == sum(min(n, limit) * c for n, c in want.items())
    lengths = sorted(want.elements())
    half = next(n for i, n in enumerate(lengths) if (i + 1) / len(lengths) >= 0.5 and (i + 1 == len(lengths) or lengths[i + 1] > n))
    assert C.quantiles(hist, [0.5]).first().n_tokens == half


def test_empty(nothing):
    assert C.length_histogram(nothing, BYTE_BPE).count() == 0
