import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from fossick.llm import pieces as P
from tests.llm.conftest import words

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b ", "Hello world", "tab\tand\nnewline \r\n x", "ünïcödé ﬁ ½ Å", "漢字かな交じり文", "👩‍👩‍👧 🇩🇪 ​﻿", "▁ marks ▁▁ here", "x" * 5000, "a\x00b", "<s> </s> <unk> <0x41>", "1234567890 !@#$%^&*()", "don't  stop   now", " lead", "trail ", "ℌ𝔢𝔩𝔩𝔬", "́combining", "é"]


def test_parity_with_the_original():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    enc = P.Encoder(MODEL)
    rng = random.Random(0)
    texts = TEXTS + [words(rng, 200) for _ in range(20)] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(60)) for _ in range(200)]
    ids, same = enc.encode(texts)
    got = [[] if not x else list(struct.unpack(f"<{len(x) // 4}i", x)) for x in ids]
    want = sp.encode(texts)
    for t, g, w in zip(texts, got, want, strict=True):
        assert g == w, t
    assert enc.decode(got) == sp.decode(want)
    assert all(same)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coded = P.encode_documents(docs, MODEL)
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = coded.collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r.token_ids == sp.encode(text[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip
    for r in P.decode_documents(coded, MODEL).collect():
        assert r.text == sp.decode(sp.encode(text[r.doc_id]))


def test_messy(messy, nothing):
    docs, rows = messy
    got = P.encode_documents(docs, MODEL).collect()
    assert len(got) == len(rows)
    assert sum(r.token_ids is None and r.n_tokens is None for r in got) == 2
    assert {r.doc_id: r.n_tokens for r in got}[5] == 0
    assert P.encode_documents(nothing, MODEL).count() == 0
    assert P.decode_documents(P.encode_documents(docs, MODEL), MODEL).where("text IS NULL").count() == 2


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(n, v):
    if isinstance(v, int):
        return _varint(n << 3) + _varint(v)
    if isinstance(v, float):
        return _varint(n << 3 | 5) + struct.pack("<f", v)
    return _varint(n << 3 | 2) + _varint(len(v)) + v


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_models(tmp_path, fallback):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    rng = random.Random(3)
    vocab = ["▁", "▁the", "the", "▁a", "ab", "abc", "b", "c", "a", "bc", "▁abc", "▁t", "h", "e", "t", "he", "▁th", "d", "cd", "bcd"]
    pieces += [(p, -1.5 - 8 * rng.random(), 1) for p in vocab]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    data += _field(2, _field(3, 1) + _field(35, int(fallback))) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    enc = P.Encoder(str(path))
    texts = ["the abc", "abcd  abcd thethe", "", "z", "a z b", "zz the éa"] + ["".join(rng.choice("abcdthe  z") for _ in range(40)) for _ in range(100)]
    ids, _ = enc.encode(texts)
    for t, x in zip(texts, ids, strict=True):
        assert list(struct.unpack(f"<{len(x) // 4}i", x)) == sp.encode(t), t


def test_columns_with_clashing_names(spark):
    rows = [(1, "some text", 5, [1], True, "x"), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int, token_ids array<int>, round_trip boolean, __text string")
    keep = ("doc_id", "n_tokens", "token_ids", "round_trip", "__text", "text")
    got = P.encode_documents(df, MODEL, keep=keep)
    assert got.columns == [*keep, "_n_tokens", "_token_ids", "_round_trip"]
    a, b = got.orderBy("doc_id").collect()
    assert (a.n_tokens, a.token_ids, a.text, a["__text"]) == (5, [1], "some text", "x") and a["_n_tokens"] == len(a["_token_ids"]) > 0 and a["_round_trip"]
    assert b["_token_ids"] is None and b["_n_tokens"] is None
    back = P.decode_documents(got, MODEL, keep=("doc_id", "text"), ids_col="_token_ids")
    assert back.columns == ["doc_id", "text", "_text"] and back.orderBy("doc_id").first()["_text"] == "some text"


def test_what_is_remembered_does_not_matter(monkeypatch):
    rng = random.Random(3)
    texts = [words(rng, 200) + " é漢" for _ in range(40)]
    want = P.Encoder(MODEL).encode(texts)
    monkeypatch.setattr(P, "REMEMBERED", 500)
    monkeypatch.setattr(P, "LEARNT", 7)
    enc, got = P.Encoder(MODEL), ([], [])
    for i in (*range(0, 40, 3), *range(0, 40, 3)):
        for whole, part in zip(got, enc.encode(texts[i : i + 3]), strict=True):
            whole += part
    assert got == ([*want[0], *want[0]], [*want[1], *want[1]])
