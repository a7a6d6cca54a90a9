"""Agent, scans, caches, extraction, encoders, evidence against brute force."""

import datetime as dt
import io
import json
import re
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fossick.functions import encoders
from fossick.functions import text as X
from fossick.operators import chats, evidence, knowledge, scan
from fossick.plans import agent, tools
from fossick.sources import caches, extract, store, views
from fossick.streaming import streams

DATA = "/root/testdata/sf0.001"
NAMES = ["keyword_search", "file_read"]


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('I will {"tool": "keyword_search", "arguments": {"keywords": ["a}b"]}} now', ("keyword_search", {"keywords": ["a}b"]})),
        ('{"name": "file_read", "args": {"paths": ["x"]}}', ("file_read", {"paths": ["x"]})),
        ('{"tool": "other"} then\n```json\n{"tool": "file_read", "parameters": {"paths": []}}\n```', ("file_read", {"paths": []})),
        ('file_read( {"paths": ["x", "y"]} )', ("file_read", {"paths": ["x", "y"]})),
        ('{broken {"tool": "file_read"}', ("file_read", {})),
        ('{"tool": "file_read", "arguments": "x"}', ("file_read", {})),
        ("nothing here {}", None), ('{"tool": "unknown"}', None), ("", None),
    ],
)
def test_tool_calls(reply, want):
    assert agent.tool_call(reply, NAMES) == want


def test_answers():
    assert agent.answer_in("x <ANSWER> a\nb </ANSWER> y") == "a\nb" and agent.answer_in("<ANSWER> </ANSWER>") is None and agent.answer_in("none") is None


def scripted(*replies):
    said, left = [], list(replies)

    def chat(messages):
        said.append([dict(m) for m in messages])
        return left.pop(0) if left else "no more", 100

    return chat, said


def test_agent(spark):
    reg = tools.standard(views.corpus(spark, DATA), views.lines(spark, DATA))
    agent.add_scan(reg, views.corpus(spark, DATA), "/corpus")
    chat, said = scripted('{"tool": "keyword_search", "arguments": {"keywords": ["edtion"]}}', "hm", '{"tool": "dir_scan", "arguments": {"query": "whst", "top_k": 3}}', "<ANSWER>done</ANSWER>")
    s = agent.run(chat, reg, "what of edtion")
    assert s.answer == "done" and not s.forced and s.turns == 4 and s.tokens == 400 and [c[0] for c in s.calls] == ["keyword_search", "dir_scan"]
    assert s.calls[0][2] > 0 and 0 < s.calls[1][2] <= 3
    assert "neither a call nor an answer" in said[2][-1]["content"] and "edtion" in said[1][-1]["content"].lower()
    chat, said = scripted(*["?"] * 3, "<ANSWER>as good as it gets</ANSWER>")
    s = agent.run(chat, reg, "q", keywords=["ention"], max_turns=4)
    assert s.forced and s.answer == "as good as it gets" and s.calls[0][1] == {"keywords": ["ention"]}
    s = agent.run(scripted("plain words")[0], reg, "q", max_turns=0)
    assert s.forced and s.answer == "plain words"
    assert agent.run(scripted("?", "<ANSWER>x</ANSWER>")[0], reg, "q", max_tokens=50).forced


def test_model_ranks(spark):
    c = scan.candidates(views.corpus(spark, DATA))
    paths = sorted(r.path for r in scan.sample(c, 4, seed=1).collect())
    chat, said = scripted('Sure: [{"path": "%s", "relevance": "medium", "reason": "r"}, {"path": "%s", "relevance": "high"}, {"path": "none.md", "relevance": "high"}]' % (paths[0].split("/")[-1], paths[1]), "no list")
    got = [(r.path, r.relevance, r.reason) for r in agent.by_model(chat, c, "q", 4, seed=1).orderBy("place").collect()]
    assert got == [(paths[1], "high", ""), (paths[0], "medium", "r")] and all(p.split("/")[-1] in said[0][0]["content"] for p in paths)
    assert {r.relevance for r in agent.by_model(chat, c, "q", 4).collect()} == {"low"}
    assert [r.path for r in scan.accepted(spark.createDataFrame([("a", "high"), ("b", "medium")], "path string, relevance string")).collect()] == ["a"]


def test_resolve(spark):
    paths = ["/r/a/report.md", "/r/b/report.md", "/r/b/quarterly_figures_2020.csv", "/r/c/only.txt"]
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    named = ["/r/b/report.md", "r\\c\\only.txt", "b/report.md", "z/only.txt", "quarterly_figures", "z/report.md", "absent.pdf", " ", "/r/c/"]
    got = {r.pos: r.path for r in scan.resolve(spark.createDataFrame(list(enumerate(named)), "pos int, named string"), f).collect()}
    assert got == {0: paths[1], 1: paths[3], 2: paths[1], 3: paths[3], 4: paths[2], 5: paths[0]}


def test_walk_and_documents(spark):
    rows = [(p, i) for i, p in enumerate(["/r/b.txt", "/r/a/z.md", "/r/a.txt", "/r/.git/x.txt", "/r/node_modules/m.js", "/r/p.egg-info/a.txt", "/r/a/b/c/d.txt", "/r/x.bin", "/q/y.txt", "/r/a-1/k.txt"])]
    f = spark.createDataFrame(rows, "path string, size_bytes int")
    assert [r.path for r in scan.walk(f, "/r", max_files=9).collect()] == ["/r/a/b/c/d.txt", "/r/a/z.md", "/r/a-1/k.txt", "/r/a.txt", "/r/b.txt"]
    assert {r.path for r in scan.walk(f, "/r/", max_depth=1).collect()} == {"/r/a/z.md", "/r/a-1/k.txt", "/r/a.txt", "/r/b.txt"}
    assert [r.path for r in scan.documents(f, ["/q/y.txt", "/r"]).collect()] == ["/r/a.txt", "/q/y.txt"]  # an empty file is left out
    assert scan.documents(f, []).count() == 0
    assert [tuple(r) for r in scan.browse(f, "/r").orderBy("place").collect()][:3] == [("a", True, 1), ("a-1", True, 2), ("node_modules", True, 3)]


def test_caches(spark, tmp_path):
    root = str(tmp_path / "meta")
    assert caches.load_metadata(spark, root).count() == 0
    f = spark.createDataFrame([("/a", 1, dt.datetime(2024, 1, 1), "text/plain", "t", ["k"])], "path string, size_bytes bigint, modified_at timestamp_ntz, mime string, title string, keywords array<string>")
    caches.save_metadata(f, root, "2024-01-02 00:00:00")
    caches.save_metadata(f.withColumn("title", F.lit("newer")), root, "2024-01-03 00:00:00")
    (tmp_path / "meta/broken.json").write_text("{not json\n")
    got = caches.load_metadata(spark, root).collect()
    assert [(r.path, r.title, r.keywords) for r in got] == [("/a", "newer", ["k"])] and len(got[0].cache_key) == 32

    root = str(tmp_path / "ctx")
    c = spark.createDataFrame([("/d/x.md", "T", ["k1", "k2"], "P"), ("/da/y.md", "U", [], "")], "path string, title string, keywords array<string>, preview string")
    caches.save_context(spark, root, ["/d", "/e/"], "sum", c, "2024-01-01 00:00:00")
    caches.save_context(spark, root, ["/d"], "later", c, "2024-01-02 00:00:00")
    now = "2024-01-03 12:00:00"
    assert caches.load_context(spark, root, ["/e", "/d", "/f"], now) == "[/e]\nsum\n\n[/d]\nlater\nKnown files:\n  - x.md  [title: T]  [keywords: k1, k2]\n    preview: P"
    assert caches.load_context(spark, root, ["/e", "/d"], now, hours=48).startswith("[/d]") and caches.load_context(spark, root, ["/d"], now, hours=1) == ""

    root = str(tmp_path / "man")
    rows = [(f"f{i}", "ab"[i % 2], f"n{i}", i, "s", dt.datetime(2024, 1, 1)) for i in range(5)]
    caches.add_files(spark.createDataFrame(rows, "file_id string, collection string, name string, size_bytes bigint, sha256 string, upload_time timestamp_ntz"), root)
    assert {tuple(r)[:3] for r in caches.collections(caches.manifest(spark, root)).collect()} == {("a", 3, 6), ("b", 2, 4)}
    assert caches.delete_file(spark, root, "f2", now) and not caches.delete_file(spark, root, "f2", now)
    assert caches.delete_collection(spark, root, "b", now) == 2
    assert sorted(r.file_id for r in caches.manifest(spark, root).collect()) == ["f0", "f4"]

    root = str(tmp_path / "audit")
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1), "1.2.3.4", "read", "/x", "ok")], "ts timestamp_ntz, client_ip string, action string, path string, result string")
    caches.audit(e, root)
    caches.audit(e, root)
    assert caches.read_audit(spark, root).count() == 2


def office(kind):
    w = 'xmlns:w="urn:w"'
    parts = {
        "docx": {"word/document.xml": f"<w:d {w}><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:d>"},
        "pptx": {f"ppt/slides/slide{i}.xml": f"<w:d {w}><w:p><w:t>slide {i}</w:t></w:p></w:d>" for i in (10, 2)},
        "xlsx": {"xl/sharedStrings.xml": f"<w:sst {w}><w:si><w:t>name</w:t></w:si></w:sst>", "xl/worksheets/sheet1.xml": f'<w:d {w}><w:row><w:c t="s"><w:v>0</w:v></w:c><w:c><w:v>4.5</w:v></w:c><w:c t="inlineStr"><w:is><w:t>in</w:t></w:is></w:c></w:row></w:d>'},
    }[kind]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return out.getvalue()


def test_extraction(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 30, 20)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 8
    rows = {"a.docx": office("docx"), "b.pptx": office("pptx"), "c.xlsx": office("xlsx"), "d.html": b"<p>a &amp; b</p><script>x</script>", "e.txt": "é".encode("latin-1") + b"t\xe9", "f.txt": "hé".encode("utf-16"), "g.png": png, "h.jpg": jpeg, "i.docx": b"broken", "j.txt": None, "k.txt": "no mark".encode("utf-16-le"), "l.pdf": b"%PDF"}
    df = spark.createDataFrame([(k, v) for k, v in rows.items()], "path string, content binary")
    got = {r.path: (r.content, r.width, r.height, r.problem) for r in extract.extracted(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.docx": "Hello there\ntwo", "b.pptx": "slide 2\n\nslide 10", "c.xlsx": "name\t4.5\tin", "d.html": "a & b", "e.txt": "été", "f.txt": "hé", "g.png": None, "h.jpg": None, "i.docx": None, "j.txt": None, "k.txt": "no mark", "l.pdf": "%PDF"}
    assert got["g.png"][1:3] == (30, 20) and got["h.jpg"][1:3] == (9, 7) and "BadZipFile" in got["i.docx"][3]
    own = {r.path: r.content for r in extract.extracted(df, extract.EXTRACTORS | {"pdf": lambda raw: f"{len(raw)} bytes"}).collect()}
    assert own["l.pdf"] == "4 bytes"
    assert extract.encoding_of("é".encode()[:1]) == "utf-8" and extract.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)


def test_encoder_and_drift(spark):
    enc = encoders.HashingEncoder(64)
    a, b, c, nothing = enc.encode(["the cat sat", "The cat, sat!", "another thing", ""])
    assert np.allclose(a, b) and abs(np.linalg.norm(a) - 1) < 1e-6 and abs(float(a @ c)) < 0.5 and not nothing.any()
    clusters = views.clusters(spark, DATA)
    hits = clusters.orderBy("id").limit(1).select("id")
    i = hits.first().id
    got = knowledge.reuse_and_embed(clusters, hits, "fresh words", enc).where(F.col("id") == i).first()
    assert np.allclose(got.embedding_vector, enc.encode(["\n".join(got.queries)])[0]) and got.queries[-1] == "fresh words" and got.embedding_model == "hashing-64" and len(got.embedding_text_hash) == 16
    assert clusters.count() == knowledge.reuse_and_embed(clusters, hits, "x", enc).count()


def test_times_and_csv_heads(spark):
    rows = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.25+01:00", "2024-01-02T03:04:05", "2024-01-02", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(X.iso_time(F.col("x"))).collect()]
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [at, at.replace(hour=2, microsecond=250_000), at, dt.datetime(2024, 1, 2), None, None]
    heads = ["name;size\nx;1\ny;2\nz;3\nu;4\n", "1,2\n3,4\n", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in heads], "x string").select(X.csv_head(F.col("x"))).collect()]
    assert (got[0].delimiter, got[0].has_header, got[0].columns, got[0].rows) == (";", True, ["name", "size"], [["x", "1"], ["y", "2"], ["z", "3"]])
    assert not got[1].has_header and got[1].columns == ["c1", "c2"] and got[1].rows == [["1", "2"], ["3", "4"]] and got[2].columns == []


def test_activity_and_references(spark):
    one, newest = knowledge.activity(views.clusters(spark, DATA), views.LIFECYCLES)
    assert sum(one.first().lifecycles.values()) == one.first().total and newest.count() == 10
    c = spark.createDataFrame([("x", [("f1", True, "s", ["a", "b", "c", "d"]), ("f2", False, "s", None), ("f3", True, None, None)])], "id string, evidences array<struct<file:string,is_found:boolean,summary:string,snippets:array<string>>>")
    assert [(r.file, r.summary, r.snippets) for r in knowledge.references(c).orderBy("pos").collect()] == [("f1", "s", ["a", "b", "c"]), ("f3", "", [])]
    s = views.sessions(spark, DATA)
    got = [r.updated_at for r in chats.recent(s, "2024-03-15 00:00:00", 24 * 90, most=5).collect()]
    assert len(got) == 5 and got == sorted(got, reverse=True)
    assert knowledge.get(views.clusters(spark, DATA), "none").count() == 0


def test_table_helpers(spark):
    store.drop_table(spark, "helper_t")
    store.create_table(spark, "helper_t", {"a": "int", "b": "string"})
    store.append_to(spark.createDataFrame([("x", 1)], "b string, a int"), "helper_t")
    store.append_to(spark.createDataFrame([("y", 2)], "b string, a int"), "helper_t")
    assert store.describe(spark, "helper_t") == [("a", "int"), ("b", "string")]
    assert [r.b for r in store.query(spark, "SELECT b FROM helper_t WHERE a = :a", a=2).collect()] == ["y"]
    store.drop_table(spark, "helper_t")
    assert not spark.catalog.tableExists("helper_t")


def test_two_writers(spark, tmp_path):
    df = spark.range(3)
    a, b = (store.SnapshotStore(spark, str(tmp_path / "s"), df.schema) for _ in range(2))
    assert a.write(df) == 1 and b.version == 1
    real = store.SnapshotStore.version
    try:
        store.SnapshotStore.version = property(lambda self: 0)  # as another writer saw it before
        with pytest.raises(store.Conflict):
            b.write(df.limit(1), expect=0)
        assert b.write(df.limit(2)) == 2
    finally:
        store.SnapshotStore.version = real
    assert a.version == 2 and a.read().count() == 2 and a.read(1).count() == 3


def test_new_files_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    seen = []
    for more in (None, "b.txt"):
        if more:
            (tmp_path / "in" / more).write_text("two!")
        streams.write_each(streams.new_files(spark, str(tmp_path / "in")), lambda df, n: seen.extend((r.path.split("/")[-1], r.size_bytes) for r in df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert seen == [("a.txt", 3), ("b.txt", 4)]


# --- evidence against brute force


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def test_token_set_score():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc "), rng.integers(0, 70))) for _ in range(2))
        assert evidence._common(a, b) == lcs(a, b)
    assert evidence.token_set_score("a needle in hay", {"needle"}) == 100 and evidence.token_set_score("", {"x"}) == 0
    near, far = evidence.token_set_score("hay needel hay", {"needle"}), evidence.token_set_score("hay stack hay", {"needle"})
    assert near > far
    s = evidence.token_set_score("fuzzy was a bear", {"fuzzy", "wuzzy"})
    assert s == pytest.approx(max(100 - 100 * (10 + 5 - 2 * lcs("a bear was", "wuzzy")) / (12 + 15), 100 - 100 * 11 / 21, 100 - 100 * 6 / 16))


def test_snapshot_lines(spark):
    lines = views.lines(spark, DATA).select("path", "line_number", "line")
    good = {(r.path, r.line_number, r.line) for r in lines.where(~X.is_noise(F.col("line"))).collect()}
    want = set()
    for path in {p for p, _, _ in good}:
        used = 0
        for _, n, line in sorted((x for x in good if x[0] == path), key=lambda x: x[1]):
            t, fill = max(1, len(line) // 4), used / 200
            if fill >= 1.2:
                break
            chance = max(0.2, 1 - 2 * fill) * (min(1.0, 0.8 + 0.4 * (1 - t / 200)) if fill > 0.5 else 1) * (0.8 + 0.4 * zlib.crc32(f"{n}:{path}".encode()) / 2**32)
            if used == 0 or used + t <= 140 or (zlib.crc32(f"{path}:{n}".encode()) / 2**32 < min(1, chance) and used + t <= 300):
                used += t
                want.add((path, n))
    got = {(r.path, r.line_number) for r in evidence.snapshot_lines(lines, budget=200).collect()}
    assert got == want and len(got) < len(good)


def test_snapshot_lines_of_a_long_file_pass_by(spark):
    """A file's lines cross many batches, none of it is held, and the budget goes on from batch to batch."""
    lines = spark.range(30_000).selectExpr("if(id < 25000, 'long', if(id < 29000, 'short', null)) path", "int(id) line_number", "concat('some words of line ', id) line").orderBy(F.rand(1))
    assert "InPandas" not in evidence.snapshot_lines(lines)._jdf.queryExecution().toString()
    want = {"long": [], "short": [], None: []}
    for i in range(30_000):
        path = "long" if i < 25_000 else "short" if i < 29_000 else None
        used, t = sum(want[path][1::2]), len(f"some words of line {i}") // 4
        fill = used / 500
        chance = max(0.2, 1 - 2 * fill) * (min(1.0, 0.8 + 0.4 * (1 - t / 500)) if fill > 0.5 else 1) * (0.8 + 0.4 * zlib.crc32(f"{i}:{path}".encode()) / 2**32)
        if fill < 1.2 and (used == 0 or used + t <= 350 or (zlib.crc32(f"{path}:{i}".encode()) / 2**32 < min(1, chance) and used + t <= 750)):
            want[path] += [i, t]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = evidence.snapshot_lines(lines, budget=500).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for path, kept in want.items():
        assert sorted(r.line_number for r in got if r.path == path) == kept[::2] and len(kept) > 50


def test_key_phrases(spark):
    docs = spark.createDataFrame([("p", "The red cat and the red dog. A red cat sat on the mat; cats sit."), ("q", ""), ("r", "the a of"), ("s", "word")], "path string, content string")
    stop = set("the a an of and or to in is are be was on for with as it that this by at from".split())

    def vector(s):
        v = np.zeros(256)
        for i in range(len(s)):
            v[zlib.crc32(f" {s} "[i : i + 3].encode()) % 256] += 1
        return v / np.linalg.norm(v)

    words = [w for w in re.findall(r"\w+", docs.first().content.lower()) if w not in stop]
    every = sorted({w for w in words if len(w) > 1} | {" ".join(p) for p in zip(words, words[1:], strict=False)})
    whole, chosen = vector(" ".join(words)), []
    for k in range(6):
        value = {p: vector(p) @ whole if not k else 0.5 * (vector(p) @ whole) - 0.5 * max(vector(p) @ vector(c) for c in chosen) for p in every if p not in chosen}
        chosen.append(max(sorted(value), key=lambda p: round(value[p], 12)))
    got = evidence.key_phrases(docs, top_k=6).collect()
    assert [r.phrase for r in sorted(got, key=lambda r: r.place) if r.path == "p"] == chosen
    assert [(r.path, r.phrase) for r in got if r.path != "p"] == [("s", "word")]


def test_key_phrases_of_long_and_odd_documents(spark):
    """As by whole vectors, equal ones in order; blocks of documents don't mix; fast enough for a corpus."""
    rng = np.random.default_rng(2)
    stop = set("the a an of and or to in is are be was on for with as it that this by at from".split())

    def vector(s):
        v = np.zeros(256)
        for i in range(len(s)):
            v[zlib.crc32(f" {s} "[i : i + 3].encode()) % 256] += 1
        return v

    def chosen(text, top_k):
        words = [w for w in re.sub(r"\W+", " ", text.lower()).split() if w not in stop]
        every = sorted({w for w in words if len(w) > 1} | {" ".join(p) for p in zip(words, words[1:], strict=False)})
        x, whole, got, best = np.array([vector(p) for p in every]).reshape(-1, 256), vector(" ".join(words)), [], 0
        norm = np.sqrt((x**2).sum(axis=1))
        for k in range(min(top_k, len(every))):
            value = x @ whole / norm / np.linalg.norm(whole) * (0.5 if k else 1) - (0.5 * best if k else 0)
            i = next(i for i in np.argsort(-np.round(value, 10), kind="stable") if every[i] not in {p for p, _ in got})
            got.append((every[i], round(x[i] @ whole / norm[i] / np.linalg.norm(whole), 5)))
            best = np.maximum(best, x @ x[i] / norm / norm[i])
        return got

    parts = ["the", "a", "x", "ab", "ba", "Éa", "ß", "漢字", "字", "😀", "𝒳y", "İx", "_", "12", "que", "la", "w" * 70, "abcabcabc", "—", ",", "\n", "of"]
    texts = [" ".join(rng.choice(parts, n)) for n in rng.integers(1, 40, 150)] + ["".join(rng.choice(list("abc "), 5000)), "", "the", "😀", "x", "la la la la"]
    rows = [(f"p{i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, "red cat"), ("null", None)], "path string, content string").coalesce(1)
    got = {}
    for r in sorted(evidence.key_phrases(df, top_k=6).collect(), key=lambda r: r.place):
        got.setdefault(r.path, []).append((r.phrase, pytest.approx(r.score, abs=2e-5)))
    assert got.pop(None)[0][0] == "red cat"
    assert got == {p: c for p, t in rows if (c := chosen(t, 6))}
    text = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(40_000))
    began = time.time()
    find = evidence._Words(evidence.STOP)
    assert len(evidence._rank_phrases([[find[w] for w in text.split()]] * 5, find, 5, 0.5)[4]) == 5 and time.time() - began < 10


def test_sampled_evidence(spark):
    files = views.corpus(spark, DATA).select("path", "content")
    words = {"edtion", "ention"}
    got = {}
    for r in evidence.evidence(files, sorted(words), whole=3000).collect():
        got.setdefault(r.path, []).append(r)
    text = {r.path: r.content for r in files.collect() if r.content}
    assert set(got) == set(text)
    for path, rows in got.items():
        t = text[path]
        if len(t) < 3000:
            assert [(r.start, r.end, r.score) for r in rows] == [(0, len(t), 10.0)]
            continue
        # every window's score by itself, and none of the windows tried everywhere is better than the best anchor
        for r in rows:
            assert r.snippet == t[r.start : r.end] and r.score == pytest.approx(evidence.token_set_score(r.snippet, words) / 10) and r.is_found == (r.score >= evidence.LEAST_SCORE)
        grid = max(evidence.token_set_score(t[min(s, len(t) - 500) :][:500], words) for s in range(0, len(t), 250)) / 10
        assert len(rows) <= 5 and (max(r.score for r in rows) >= min(grid, 8.0) - 1e-9 or grid < 1)


def test_fragments(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    f = spark.createDataFrame([("p", text)], "path string, content string")
    w = spark.createDataFrame([("p", 3000, 3500), ("p", 100, 600)], "path string, start int, end int")
    got = evidence.fragments(w, f).first().context
    assert got == f"\n--- Context Fragment 1 ---\n...{text[0:1350]}...\n\n--- Context Fragment 2 ---\n...{text[2250:4250]}...\n"


def test_bench_goes_on_after_a_failure():
    import ast
    from pathlib import Path

    import bench
    from fossick.plans import catalog

    assert {n for n in bench.HEADLINE if not n.startswith("op")} <= set(catalog.QUERIES)
    assert ast.parse(Path(bench.__file__).read_text()) and json.dumps({})
