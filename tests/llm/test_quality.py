import random

import duckdb

from fossick.llm import quality as Q
from fossick.llm.queries import op2_quality_rules
from tests.llm.conftest import words

DATA = "/root/testdata/sf0.001"


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(Q.keep_sql()).fetchall())
    assert sorted(tuple(r) for r in op2_quality_rules(spark, DATA).select("doc_id", "lang", "source", "n_chars").collect()) == want
    why = dict(con.execute("SELECT doc_id, reason FROM (" + Q.judge_sql() + ")").fetchall())
    got = {r.doc_id: r.reason for r in Q.judge(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert got == why


def test_rules(make):
    good = "The river ran past the old mill and the children watched boats drift toward the quiet harbour until evening came over the town."
    cases = {"blank": " \n", "symbols": "## $$ %% && ** |", "shouting": "READ THIS NOW OR ELSE", "digits": "1234567 8901234 5678901 2345678 90123", "word_length": " ".join(["x" * 40] * 6), "repeated_lines": "\n".join(["same line here"] * 9), "repeated_words": "alpha beta " * 40}
    rows = [(0, good, "s")] + [(i + 1, t, "s") for i, t in enumerate(cases.values())]
    got = {r.doc_id: (r.kept, r.reason) for r in Q.judge(make(rows)).collect()}
    assert got[0] == (True, None)
    for i, name in enumerate(cases):
        assert got[i + 1] == (False, name), name


def test_blank_lines_are_no_repeated_lines(spark, make):
    rng = random.Random(4)
    paragraphs = [words(rng, 30) for _ in range(40)]
    texts = ["\n\n".join(paragraphs), "\n \t\n".join(paragraphs), "\r\n\r\n".join(paragraphs) + "\n\n\n", "\n\n".join(paragraphs[:4] * 6), "\n\n".join(paragraphs[:9])]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    want = [None, None, None, "repeated_lines", None]
    assert [r.reason for r in Q.judge(make(rows)).orderBy("doc_id").collect()] == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, NULL, ?, NULL)", rows)
    assert [r[0] for r in con.execute(f"SELECT reason FROM ({Q.judge_sql()}) ORDER BY doc_id").fetchall()] == want


def test_order_does_not_matter(make, messy):
    docs, _ = messy
    forward = sorted(map(str, Q.keep_good(docs).collect()))
    assert sorted(map(str, Q.keep_good(docs, rules=Q.RULES[::-1]).collect())) == forward


def test_plan_has_every_rule(messy):
    plan = Q.plan_cascade(messy[0])
    assert {r.name for r, _, _ in plan} == {r.name for r in Q.RULES}
    score = [-hit / cost for _, cost, hit in plan]
    assert score == sorted(score)


def test_messy_and_empty(messy, nothing):
    docs, rows = messy
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 2 and not {4, 5, 6} & set(ids) and 7 in ids
    assert Q.keep_good(nothing).count() == 0
