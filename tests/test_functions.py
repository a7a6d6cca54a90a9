"""Formulas on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fossick.functions import matching as M
from fossick.functions import scoring as S
from fossick.functions import text as X
from fossick.sources import views


def one(spark, column, *values, names="x"):
    df = spark.createDataFrame([values], [*names] if len(values) > 1 else [names])
    return df.select(column.alias("y")).first().y


def test_line_relevance(spark):
    terms = ["cat", "elephant"]
    line = "A cat, concatenated cats."
    tf = 3
    want = tf / (tf + 1) * 2 * (3 / 5) * 1 / ((len(line) + 1) / 100 + 1)
    assert one(spark, S.line_relevance(F.col("x"), terms), line) == pytest.approx(want)
    assert one(spark, S.line_relevance(F.col("x"), terms, whole_word=True), line) == pytest.approx(0.5 * 2 * 0.6 / ((len(line) + 1) / 100 + 1))
    assert one(spark, S.line_relevance(F.col("x"), terms), "") == 0
    assert one(spark, S.line_relevance(F.col("x"), ["cat"], length_norm="none", saturation="raw", isolated_bonus=1), "catcat") == pytest.approx(2 * 0.6)
    with pytest.raises(ValueError):
        S.line_relevance(F.col("x"), terms, [1.0])


def test_file_score(spark):
    s = S.file_score({"ab": F.col("x"), "abcdefgh": F.lit(0)})
    assert one(spark, s, 7) == pytest.approx(0.5 * (1 + math.log(7)))


@pytest.mark.parametrize(("name", "pattern", "score"), [("foo", ".*foo.*", 1.0), ("FOO", ".*foo.*", 0.9), ("foo.txt", ".*foo.*", 0.8), ("Foo.txt", ".*foo.*", 0.75), ("a_foo", ".*foo.*", 0.6), ("a_Foo", ".*foo.*", 0.55), ("atxt", "a.txt", 1.0), ("a.txt", "a.txt", 1.0), ("A.TXT", "a.txt", 0.9), ("other", "zz", 0.3 + 0.2 * 2 / 5)])
def test_filename_score(spark, name, pattern, score):
    assert one(spark, S.filename_score(F.col("x"), pattern), name) == pytest.approx(score)


def test_filename_score_by_case(spark):
    assert one(spark, S.filename_score(F.col("x"), "foo", case_sensitive=True), "FOO") == 0.75


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.y for r in df.select(S.cosine(F.col("a"), F.col("b")).alias("y")).collect()]
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and got[1:] == [None] * 3


@pytest.mark.parametrize(("glob", "yes", "no"), [("*.py", "a.py", "a.pyc"), ("a?c", "abc", "ac"), ("**/b/*.md", "/x/y/b/c.md", "/x/b/d/c.md"), ("[ab].c", "a.c", "c.c"), ("[!a].c", "b.c", "a.c"), ("a.b", "a.b", "axb")])
def test_globs(spark, glob, yes, no):
    p = M.glob_pattern(glob)
    assert one(spark, F.col("x").rlike(p), yes) and not one(spark, F.col("x").rlike(p), no)


def test_predicates(spark):
    assert one(spark, M.literal(F.col("x"), "É"), "café")
    assert one(spark, M.whole_word(F.col("x"), "a.b"), "x a.b y") and not one(spark, M.whole_word(F.col("x"), "cat"), "concat")
    assert one(spark, M.any_of(F.col("x"), ["a+b", "\\E"]), "1 A+B") and not one(spark, M.any_of(F.col("x"), ["a+b"]), "aab")


def test_replies(spark):
    t = "noise <SUMMARY> a\nb </SUMMARY> <SHOULD_SAVE>Yes</SHOULD_SAVE>"
    d = one(spark, X.summary_decision(F.col("x")), t)
    assert tuple(d) == ("a\nb", False, True)
    for bare in (" all of it <SHOULD_SAVE>true</SHOULD_SAVE>", "<SUMMARY> </SUMMARY><SHOULD_ANSWER>yes</SHOULD_ANSWER>\n"):
        assert tuple(one(spark, X.summary_decision(F.col("x")), bare)) == (bare.strip(), False, False)
    assert one(spark, X.tag_field(F.col("x"), "ABSENT"), t) is None
    for reply in ('{"score": 7.5}', '```json\n{"score": 7.5}\n```', 'I say {"score": 7.5} so', "Score: 7.5"):
        assert one(spark, X.salvage_score(F.col("x")), reply) == 7.5
    assert one(spark, X.salvage_score(F.col("x")), "none") is None
    assert one(spark, X.keyword_map(F.col("x")), "k: {'a': 20, 'b': 0.5, 'c': 3}") == {"a": 10.0, "b": 1.0, "c": 3.0}


def test_samples(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    assert one(spark, X.head_middle_tail(F.col("x"), 100, "|"), text) == "\n".join([text[:40], "|", text[480:520], "|", text[-20:]])
    assert one(spark, X.head_middle_tail(F.col("x"), 960, "|"), text) == "\n".join([text[:384], "|", text[384:692], "|", text[-192:]])
    assert one(spark, X.head_middle_tail(F.col("x"), 1000), text) == text
    assert one(spark, X.chunks(F.col("x"), 300), text) == [text[i : i + 300] for i in range(0, 1000, 300)]
    assert [tuple(w) for w in one(spark, X.windows(F.col("x")), text)] == [(i, text[i : i + 500]) for i in range(0, 1000, 250)]
    assert one(spark, X.estimated_tokens(F.col("x")), "") == 1


def test_metadata(spark):
    text = "\n## \n# The title here \nsecond line, with Words (and) words\nabc\n"
    assert one(spark, X.title_line(F.col("x")), text) == "The title here"
    assert one(spark, X.head_keywords(F.col("x")), text) == ["title", "here", "second", "line", "with", "words"]
    assert one(spark, X.head_keywords(F.col("x")), "tiny\n" * 9 + "the tenth line counts\nwhat follows doesn't") == ["tenth", "line", "counts"]
    for nothing in ("", "A.", " \n \t\n", None):
        got = spark.createDataFrame([(nothing,)], "x string").select(X.title_line(F.col("x")), X.head_keywords(F.col("x")), X.estimated_lines(F.col("x"), F.lit(2))).first()
        assert got[0] == "" and not got[1]
    assert one(spark, X.estimated_lines(F.col("x"), F.lit(100)), "é\né\n") == int(2 * (100 / 6))
    assert one(spark, X.human_size(F.col("x")), 1536) == "1.5 KB" and one(spark, X.human_size(F.col("x")), 1280) == "1.2 KB" and one(spark, X.human_size(F.col("x")), 12) == "12 B"
    assert one(spark, X.safe_filename(F.col("x")), "../a b?.txt") == "a b_.txt" and one(spark, X.safe_filename(F.col("x")), "...") == "unnamed"
    assert one(spark, X.split_keywords(F.col("x")), "a, b;;c|d ") == ["a", "b", "c", "d"]
    assert tuple(one(spark, X.highlight(F.col("x"), "EP"), "report")) == (1, 3)
    big = bytes(range(256)) * 100
    import hashlib

    df = spark.createDataFrame([(big,)], "x binary")
    assert df.select(X.fingerprint(F.col("x"), F.length("x"))).first()[0] == hashlib.md5(big[:8192] + big[-8192:]).hexdigest() + "_25600"


NOISE = [
    "short", "----------------", "Copyright 2020 by someone", "https://example.org/page", "aaaaaaaaaaaaaaaaaaaaaaaa", "|---|---|---|---|", "!@ $% ^& *( )_ +a b", "![a picture of it](http://x.org/a.png)", "[ref]: https://example.org/a/b", "``` python      ",
    "####### much too deep", "page 12 of the book", "12 of 345 pages"[:9], "Created: 2020-01-01", "wait . . . . what is it", "see >>>> this is it then", "someone@example.org www.example.org", "12.  https://example.org/page",
]


@pytest.mark.parametrize(("line", "noise"), [*((x, True) for x in NOISE), ("An ordinary sentence of prose.", False), ("# A heading of some length", False), ("the copyright is mentioned here", False), ("look at https://example.org for more", False), ("He said hello... and left", False)])
def test_noise(spark, line, noise):
    assert one(spark, X.is_noise(F.col("x")), line) is noise


def test_plain_lines_are_judged_as_all(spark):
    """The short way for plain lines gives what the whole rule gives, on random lines of letters, marks and blanks; the lines
    of a corpus take it."""
    rng = random.Random(3)
    parts = ["a", "B", "é", "漢", "7", " ", " ", ".", ",", "-", "*", "#", "_", "|", "aaaaa", "word", "the ", "copyright ", "page 3", "www.x", "http://y", "a@b.cd", "12 of 14", "\t", "\r", "😀", "....", "𝒳"]
    lines = ["".join(rng.choices(parts, k=rng.randrange(1, 16))) for _ in range(6000)] + ["".join(rng.choices(["a ", "b. ", "ab, ", "cde", "!", "x"], k=rng.randrange(5, 30))) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    s, n = F.btrim("x", F.lit(" \t\r")), F.length(F.btrim("x", F.lit(" \t\r")))
    letters = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    rest = F.btrim(F.regexp_replace(F.regexp_replace(s, X.LINKS, ""), X.MARKUP, ""), F.lit(" \t\r"))
    one = F.exists(F.regexp_extract_all(s, F.lit(r"(.)\1{4}"), 1), lambda c: n - F.length(F.replace(s, c, F.lit(""))) > 0.6 * n)
    whole = (
        (n < 10) | s.rlike(X.MARKUP) | (letters(s) < 0.3 * n) | one | s.rlike(r"([^\p{L}\p{N}_\s])\s*\1\s*\1\s*\1") | F.lower(s).rlike(X.SMALL_PRINT)
        | (F.length(rest) < 3) | (letters(rest) < 0.4 * F.length(rest)) | (F.length(F.regexp_replace(s, r"[^#*_~`>!\[\](){}|:-]", "")) > 0.6 * n)
    )
    rows = df.select("x", X.is_noise(F.col("x")).alias("got"), whole.alias("want"), s.rlike(X.PLAIN).alias("plain")).collect()
    assert [r for r in rows if r.got != r.want] == [] and {(r.got, r.plain) for r in rows} == {(a, b) for a in (True, False) for b in (True, False)}
    assert spark.createDataFrame([(None,)], "x string").select(X.is_noise(F.col("x"))).first()[0] is None
    corpus = views.lines(spark, "/root/testdata/sf0.001").where(F.length("line") >= 10)
    assert corpus.where(F.col("line").rlike(X.PLAIN)).count() > 0.9 * corpus.count()
