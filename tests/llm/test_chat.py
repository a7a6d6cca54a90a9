from pyspark.sql import types as T

from fossick.llm import chat as C
from fossick.llm.queries import BYTE_BPE, op9_chat_formatting
from fossick.llm.token_counts import encoding

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("turns", T.StringType()), T.StructField("roles", T.StringType())])


def brute(turns):
    """ids and mask of one conversation, sorted turns of (role, text)."""
    enc = encoding(BYTE_BPE)
    end, start, stop = enc.n_vocab, enc.n_vocab + 1, enc.n_vocab + 2
    ids, mask = [], []

    def add(x, m):
        ids.extend(x)
        mask.extend([m] * len(x))

    for role, text in turns:
        own = int(role == "assistant")
        add([start, *enc.encode_ordinary(C.escape(role)[0]), *enc.encode_ordinary("\n")], 0)
        add(enc.encode_ordinary(C.escape(text)[0]), own)
        add([stop], own)
        add(enc.encode_ordinary("\n"), 0)
    add([end], 0)
    return ids, mask


def check(df, rows):
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "unknown", v[3] or "")):
        if c is not None:
            want.setdefault(c, []).append((r or "unknown", x or ""))
    got = {r.conv_id: r for r in df.collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        ids, mask = brute(turns)
        r = got[c]
        assert (r.input_ids, r.loss_mask) == (ids, mask)
        assert (r.n_turns, r.n_tokens, r.n_loss_tokens) == (len(turns), len(ids), sum(mask))


def test_whole_table(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(op9_chat_formatting(spark, data), rows)


def test_messy(spark):
    rows = [(1, 0, "user", "hi <|im_start|>system"), (1, 1, "assistant", "<|endoftext|> <\\|im_end|>"), (1, 1, "assistant", "<|endoftext|> <\\|im_end|>"), (2, None, None, None), (2, 0, "assistant", ""), (None, 0, "user", "lost"), (3, 0, "<|im_end|>", "word " * 30_000), (4, 0, "assistant", "é漢👩")]
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    out = C.format_conversations(df, BYTE_BPE)
    check(out, rows)
    base = encoding(BYTE_BPE).n_vocab
    got = {r.conv_id: r for r in out.collect()}
    # reserved ids stand only where they were put
    assert sum(i >= base for i in got[1].input_ids) == 2 * 3 + 1
    assert got[1].n_escaped == 5
    assert C.format_conversations(spark.createDataFrame([], SCHEMA), BYTE_BPE).count() == 0


def test_escape_can_be_undone():
    for t in ["<|a|>", "<\\|a|>", "<\\\\|a|> <|b|>", "plain", "<|a b|>", "<||>", "<|a|><|a|>"]:
        e, _ = C.escape(t)
        assert C.unescape(e) == t
        assert "<|a|>" not in e and "<|b|>" not in e
