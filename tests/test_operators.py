"""Operators on hand-made tables: stores, files, clusters, evidence, streams, searches."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from fossick.functions.text import estimated_tokens
from fossick.operators import chats, evidence, files, knowledge, retrieval, tables
from fossick.plans import search as plans
from fossick.sources import store, views
from fossick.streaming import streams

DATA = "/root/testdata/sf0.001"


def test_prune(spark):
    def kept(scores, **how):
        df = spark.createDataFrame([(f"p{i}", float(s)) for i, s in enumerate(scores)], "path string, score double")
        return [r.score for r in retrieval.prune(df, **how).orderBy("rank").collect()]

    assert kept([10, 9, 8, 2.9, 1]) == [10, 9, 8]
    assert kept([10, 4, 3.5]) == [10]
    assert kept([10, 6, 4, 3.5]) == [10, 6, 4, 3.5]
    assert kept([0, 0, 0], top_k=2) == [0, 0]
    assert kept([5]) == [5] and kept([]) == []


def test_budget(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([600, 300, 400, 10])], "i int, content string")
    got = {r.i: len(r.content) for r in retrieval.char_budget(df, ["i"], budget=1200).collect()}
    assert got == {0: 600, 1: 300, 2: 300}
    assert {r.i for r in retrieval.char_budget(df, ["i"], budget=1000).collect()} == {0, 1}


def test_history_keeps_one(spark):
    df = spark.createDataFrame([(1, 0, "user", "a" * 10), (1, 1, "assistant", "b" * 10_000)], "session_id int, turn int, role string, content string")
    assert [r.turn for r in chats.history_window(df, max_tokens=100).collect()] == [1]
    assert df.select(estimated_tokens(F.col("content")).alias("n")).agg(F.max("n")).first()[0] == int(10_000 / 3.5)


def stored(spark, old, new, **how):
    old = spark.createDataFrame([("c", n, 1, "x", 0) for n in old], "collection string, name string, size_bytes bigint, sha256 string, upload_time int")
    rows = [("c", n, t, i) if isinstance(n, str) else (*n, t, i) for i, (n, t) in enumerate(new)]
    up = spark.createDataFrame(rows, "collection string, name string, content string, upload_time int").withColumn("content", F.col("content").cast("binary"))
    return sorted(r.name for r in files.store_uploads(old, up, max_bytes=20, extensions=["txt"], **how).collect())


def test_uploads(spark):
    new = [("a.txt", "one"), ("a.txt", "two"), ("b.exe", "three"), (("bad name", "c.txt"), "x"), ("d.txt", ""), ("e.txt", "long" * 9)]
    assert stored(spark, ["a.txt"], new) == ["a.txt", "a_1.txt", "a_2.txt"]
    assert stored(spark, ["a.txt", "a_1.txt"], [("a.txt", "x")]) == ["a.txt", "a_1.txt", "a_2.txt"]
    got = stored(spark, ["a_1.txt", "a_3.txt", "a_4.txt"], [("a.txt", str(i)) for i in range(4)])
    assert got == ["a.txt", "a_1.txt", "a_2.txt", "a_3.txt", "a_4.txt", "a_5.txt", "a_6.txt"]
    got = stored(spark, ["a.txt"], [("a.txt", "1"), ("a_1.txt", "2"), ("a_1.txt", "3"), ("a.txt", "4")])
    assert got == ["a.txt", "a_1.txt", "a_1_1.txt", "a_2.txt", "a_3.txt"] and len(set(got)) == len(got)
    assert stored(spark, ["a.txt"], [("b.txt", "12345"), ("c.txt", "12345"), ("d.txt", "12345")], quota=11) == ["a.txt", "b.txt", "c.txt"]


def test_split(spark):
    rows = [("x", "n", [(f"e{i}", "f", True) for i in range(5)], ["p", "q", "r"], "STABLE", 4), ("y", "m", [("e", "f", True)], ["p"], "STABLE", 2)]
    c = spark.createDataFrame(rows, "id string, name string, evidences array<struct<doc_id:string,file:string,is_found:boolean>>, patterns array<string>, lifecycle string, version int")
    got = {r.id: (r.name, [e.doc_id for e in r.evidences], r.patterns, r.lifecycle, r.version) for r in knowledge.split(c, 2).collect()}
    assert got == {"x_split1": ("n (part 1)", ["e0", "e1"], ["p", "r"], "EMERGING", 1), "x_split2": ("n (part 2)", ["e2", "e3", "e4"], ["q"], "EMERGING", 1), "y": ("m", ["e"], ["p"], "STABLE", 2)}
    assert {r.id for r in knowledge.split(c, 1).collect()} == {"x", "y"}


def test_reuse_and_merge(spark):
    c = views.clusters(spark, DATA)
    hit = c.orderBy("id").limit(1).select("id")
    before, after = c.join(hit, "id").first(), knowledge.reuse(c, hit, "fresh").join(hit, "id").first()
    assert after.version == before.version + 1 and after.queries[-1] == "fresh" and len(after.queries) <= 5
    rows = [(1, "k", 1.0), (2, "k", 0.5), (3, "k", 0.25)]
    edges = spark.createDataFrame([(i, k, f"n{i}", ["d"], ["p"], [(f"e{i % 2}", "f", True)], [(7, w, "s")], 0.5, None, i) for i, k, w in rows], "seq int, key string, name string, description array<string>, patterns array<string>, evidences array<struct<doc_id:string,file:string,is_found:boolean>>, related_clusters array<struct<target:bigint,weight:double,source:string>>, confidence double, hotness double, version int")
    m = knowledge.merge(edges, "key", "seq").first()
    assert m.edges == {7: ((1.0 + 0.5) / 2 + 0.25) / 2} and m.doc_ids == ["e1", "e0"] and m.version == 4 and m.hotness is None


def test_merge_of_large_groups(spark):
    """As a walk over the sorted rows gives it; the time of a group grows with its rows."""
    kind = "seq int, key string, name string, description array<string>, patterns array<string>, evidences array<struct<doc_id:string>>, related_clusters array<struct<target:bigint,weight:double>>, confidence double, hotness double, version int"
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b"]), f"n{i}", [f"d{i % 5}", None], None if i % 7 == 0 else ["p"], [(f"e{rng.randrange(9)}",) for _ in range(i % 4)], [(rng.randrange(20), rng.choice([None, rng.random()])) for _ in range(i % 3)], i / 9, None, i) for i in range(200)]
    rows.append((999, "alone", "n", [], [], [], [], None, None, 1))
    want = {}
    for r in rows:
        w = want.setdefault(r[1], [0, f"{r[2]} (merged)", {}, {}])
        w[0] += 1
        w[2] |= {e: None for (e,) in r[5] if e not in w[2]}
        for t, x in r[6]:
            m = w[3].pop(t, None)
            w[3][t] = x if m is None or x is None else (m + x) / 2
    got = knowledge.merge(spark.createDataFrame(rng.sample(rows, len(rows)), kind), "key", "seq").withColumn("edges", F.map_entries("edges")).collect()
    assert {r.key: (r.n_merged, r.name, r.doc_ids, list(map(tuple, r.edges))) for r in got} == {k: (n, name, list(d), list(e.items())) for k, (n, name, d, e) in want.items()}
    assert {r.key: (r.description, r.patterns) for r in got}["a"] == (["d0", "d1", "d2", "d3", "d4", None], ["p"]) and {r.key: r.description for r in got}["alone"] == []
    many = spark.range(60_000).selectExpr("int(id) seq", "'k' key", "'n' name", "array('d') description", "array('p') patterns", "array(named_struct('doc_id', string(id))) evidences", "array(named_struct('target', id, 'weight', 1D), named_struct('target', id + 1, 'weight', 0.5D)) related_clusters", "1D confidence", "1D hotness", "1 version")
    began = time.time()
    r = knowledge.merge(many, "key", "seq").select("n_merged", F.size("doc_ids").alias("d"), F.size("edges").alias("e"), F.col("edges")[5].alias("w")).first()
    assert tuple(r) == (60_000, 60_000, 60_001, 0.75) and time.time() - began < 60


def test_embedding_length_is_checked(spark):
    c = views.clusters(spark, DATA)
    bad = c.limit(1).select("id", F.array(F.lit(1.0).cast("float")).alias("vector"))
    with pytest.raises(Exception, match="ASSERT_TRUE|assert_true|is not true"):
        knowledge.store_embedding(c, bad, 64).collect()


def test_store(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") * 2).alias("v"))
    s = store.SnapshotStore(spark, str(tmp_path / "t"), df.schema)
    assert s.read().count() == 0 and s.version == 0
    assert s.write(df) == 1 and s.write(s.read().where("id > 2"), expect=1) == 2
    assert s.read().count() == 2 and s.read(1).count() == 5
    with pytest.raises(store.Conflict):
        s.write(df, expect=1)


def test_round_trips(spark, tmp_path):
    n = views.table(spark, DATA, "nation")
    store.export_csv(n, str(tmp_path / "csv"), "|")
    assert sorted(map(tuple, store.import_csv(spark, str(tmp_path / "csv"), "|").collect())) == sorted(map(tuple, n.collect()))
    store.export_tables({"a": n}, str(tmp_path / "all"))
    assert store.import_tables(spark, str(tmp_path / "all"))["a"].count() == 25


def test_files_and_settings(spark, tmp_path):
    (tmp_path / "d/.git").mkdir(parents=True)
    (tmp_path / "d/x.md").write_text("# hello\n")
    (tmp_path / "d/p.html").write_text("<p>some <b>text</b></p><script>no</script>")
    (tmp_path / "d/bad.txt").write_bytes(b"ok \xff\xfe")
    (tmp_path / "d/.git/config").write_text("x")
    got = files.select_files(store.binary_listing(spark, str(tmp_path / "d")), str(tmp_path / "d"))
    assert sorted(r.filename for r in got.collect()) == ["bad.txt", "p.html", "x.md"]
    text = {r.path.split("/")[-1]: r.content for r in store.text_files(spark, str(tmp_path / "d")).collect()}
    assert text["p.html"] == "some text" and text["bad.txt"].startswith("ok �")
    (tmp_path / "env").write_text("# c\nA=1\nB='x=y'\n\nC=\"q\"\nbroken\n")
    assert {tuple(r) for r in store.env_file(spark, str(tmp_path / "env")).collect()} == {("A", "1"), ("B", "x=y"), ("C", "q")}
    (tmp_path / "cache").mkdir()
    for i, day in enumerate((1, 4)):
        (tmp_path / f"cache/{i}.json").write_text(json.dumps({"search_path": f"p{i}", "cached_at": f"2024-01-0{day}T00:00:00", "summary": "s"}))
    assert [r.search_path for r in store.cached_contexts(spark, str(tmp_path / "cache"), "2024-01-05 00:00:00").collect()] == ["p1"]


def test_scripts(spark):
    assert store.split_script("SELECT ';' AS a; -- no; no\nSELECT 2; /* ; */ ;") == ["SELECT ';' AS a", "SELECT 2"]
    assert store.run_script(spark, "SELECT 1; SELECT 'a;b' AS x").first().x == "a;b"


def test_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert [r.s for r in tables.update_rows(df, F.col("s") == "a", {"s": F.lit("b")}).orderBy("i").collect()] == ["b", None]
    assert tables.delete_rows(df, F.col("s") == "a").count() == 1


def test_evidence():
    words = {"needle", "thread"}
    text = ("hay " * 30_000) + "needle and thread in one place " + ("straw " * 10_000)
    got = evidence.sample_document("p", text, words)
    assert got == evidence.sample_document("p", text, words)
    s, e, score, _ = got[0]
    assert "needle and thread" in text[s:e] and score == 10
    assert evidence.sample_document("p", "short", words) == [(0, 5, 10.0, 0)] and evidence.sample_document("p", "", words) == []
    missing = evidence.sample_document("p", "hay " * 30_000, words)
    assert len(missing) == 1 and missing[0][2] < evidence.LEAST_SCORE


def test_searches(spark):
    corpus, lines = views.corpus(spark, DATA), views.lines(spark, DATA)
    a = plans.search(corpus, lines, "edtion ention")
    assert a.paths and len(a.text) <= 15_000 + 200 * len(a.paths)
    assert a.cluster.first().lifecycle == "EMERGING"
    best = retrieval.rank_files(lines, ["edtion", "ention"]).orderBy(F.desc("score"), "path").first().path
    assert a.paths[0] == best
    assert plans.search(corpus, lines, "hello!").text == ""
    assert plans.search(corpus, lines, "doc_1?.txt", mode="FILENAME_ONLY").count() == 10
    d = plans.search(corpus, lines, "edtion ention", mode="DEEP")
    assert d.paths and best in d.paths


def test_streams(spark, tmp_path):
    events = views.table(spark, DATA, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.table_stream(spark, str(tmp_path / "in"), events.schema, files_per_batch=1)
    usage = stream.select(F.col("event_type").alias("model"), F.lit(1).cast("bigint").alias("prompt_tokens"), F.lit(2).cast("bigint").alias("completion_tokens"))
    last = {}

    def keep(df, n):
        last.update({r.model: (r.calls, r.completion_tokens) for r in df.collect()})

    streams.write_each(streams.running_usage(usage), keep, str(tmp_path / "c1"), mode="update").awaitTermination(120)
    assert last == {r.event_type: (r["count"], 2 * r["count"]) for r in events.groupBy("event_type").count().collect()}


def test_rate_limiter(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    hits = [("a", t0 + dt.timedelta(milliseconds=100 * i)) for i in range(8)] + [("a", t0 + dt.timedelta(seconds=2)), ("b", t0)]
    spark.createDataFrame(hits, "ip string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.rate_limited(streams.table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "ip")
    got = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    streams.write_each(s, lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "c")).awaitTermination(120)
    assert sum(ok for k, _, ok in got if k == "a") == 6 and len(got) == 10 and all(ok for k, _, ok in got if k == "b")


def test_tools(spark):
    from fossick.plans import tools

    reg = tools.standard(views.corpus(spark, DATA), views.lines(spark, DATA), views.clusters(spark, DATA))
    rows, error = reg.call("keyword_search", keywords=["edtion"])
    assert rows and not error
    path = rows[0]["path"]
    assert len(reg.call("file_read", paths=[path])[0]) == 1 and reg.call("file_read", paths=[path])[0] == []
    assert reg.call("knowledge_query", query="Topic 3", limit=2)[0]
    assert reg.call("nothing")[1] and reg.call("file_read", other=1)[1]


def test_valid_paths(spark):
    rows = [(" /a ", 0), ("/a", 1), ("", 2), ("-x", 3), ("http:///p", 4), ("/a/../b", 5), (None, 6), ("/b/c", 7)]
    df = spark.createDataFrame(rows, "path string, pos int")
    assert sorted(map(tuple, files.valid_paths(df).collect())) == [("/a", 0), ("/b/c", 7)]
    assert [r.path for r in files.allowed(df, ["/b"]).collect()] == ["/b/c"]
