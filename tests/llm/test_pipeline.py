import random
from collections import Counter

import duckdb
import pytest
import sentencepiece

import corpus_pipeline as C
from fossick.llm import mixing, quality
from fossick.llm.common import write_table
from fossick.llm.queries import SENTENCE_PIECES
from tests.llm import test_lines, test_simhash

DATA = "/root/testdata/sf0.001"
NAMES = ["quality rules", "line dedup", "SimHash near-dedup", "source mixing", "SentencePiece encoding"]


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and the last one's result."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, f in C.STAGES:
        df, _ = write_table(f(spark, out[-1], DATA))
        out.append(df)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert [n for n, _ in C.STAGES] == NAMES
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert stages[-1].columns == ["doc_id", "n_tokens", "token_ids", "round_trip"]


def test_quality(stages):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    kept = {i for i, *_ in con.execute(quality.keep_sql()).fetchall()}
    assert Counter(rows(stages[1])) == Counter(r for r in rows(stages[0]) if r[0] in kept)


def test_lines_go(stages):
    before, after = dict(rows(stages[1])), dict(rows(stages[2]))
    gone = test_lines.brute(list(before.items()))
    assert set(after) == set(before)
    missed = 0
    for i, t in before.items():
        all_lines = t.split("\n")
        must = "\n".join(x for n, x in enumerate(all_lines) if (i, n) not in gone)
        missed += after[i] != must
        assert Counter(must.split("\n")) - Counter(after[i].split("\n")) in (Counter(), Counter([""]))
    assert missed <= 0.05 * max(1, len({i for i, _ in gone}))
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[2]), rows(stages[3])
    replaced = {i for i, _ in test_simhash.brute(before)}
    kept = {i for i, _ in after}
    assert {i for i, _ in before} - replaced <= kept
    assert len(kept & replaced) <= 0.1 * max(1, len(replaced))  # the search is approximate: recall of at least 0.9
    assert set(after) <= set(before)


def test_near_dedup_misses_few(stages):
    replaced = {i for i, _ in test_simhash.brute(rows(stages[2]))}
    assert replaced and len({i for i, _ in rows(stages[3])} & replaced) <= 0.05 * len(replaced)


def test_mixing(stages):
    before, after = Counter(rows(stages[3])), Counter(rows(stages[4]))
    assert set(before) == set(after)
    first = Counter(r.doc_id for r in mixing.schedule(stages[3]).where("from_token = 0").collect())
    assert Counter(i for i, _ in after.elements()) == first


def test_encoding(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=SENTENCE_PIECES)
    want = Counter((i, tuple(sp.encode(t))) for i, t in rows(stages[4]))
    got = stages[5].collect()
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)


def test_run(spark, stages):
    want = Counter((r.doc_id, r.n_tokens) for r in stages[5].collect())
    assert Counter((r.doc_id, r.n_tokens) for r in C.run(spark, DATA).collect()) == want


def test_empty_and_messy(spark, nothing, messy):
    for df in (nothing, messy[0]):
        for name, f in C.STAGES:
            columns = df.columns
            df, _ = write_table(f(spark, df, DATA))
            assert name == NAMES[-1] or df.columns == columns
    ids = [r.doc_id for r in df.collect()]
    assert {1, 7, 9} <= set(ids)


def test_line_dedup_verifies_few_lines_that_share_a_key_by_chance(spark, make, monkeypatch):
    """The second stage, in a language of few syllables: what goes on to be verified doesn't grow with the square of the lines."""
    rng = random.Random(12)
    syllables = ["the", "an", "ing", "tion", "er", "ou", "nd", "sh", "ha", "ble", "ly", "st", "in", "or", "wh", "ed"]
    line = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60)))
    write, sizes = test_lines.L.write_table, []

    def counted(df):
        out = write(df)
        if df.columns == ["grp", "node", "bands"]:
            sizes.append(out[0].count())
        return out

    monkeypatch.setattr(test_lines.L, "write_table", counted)
    for n in (200, 800):
        rows = [(k, "\n".join(line() for _ in range(10)), "s") for k in range(n)]
        assert C.line_dedup(spark, make(rows), "").count() == n
    assert sizes[1] < 0.05 * 8000, sizes
