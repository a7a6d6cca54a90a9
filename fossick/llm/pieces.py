"""SentencePiece encoding and decoding by the ``tokenizers`` library, rebuilt from the model's protobuf.

The protobuf is parsed by hand: pieces with scores and types, trainer and normaliser settings. From them come the
normaliser, the metaspace marker, merges by piece rank (BPE) or scores (unigram) and byte fallback. Where no piece
holds a marker behind another character, no merge crosses the start of a word, so a text is encoded as its words: each
worker encodes a batch's unseen words at once on several threads and joins the ids of all words.

Defined results: a null text gives null ids, an empty text none; rows, ties and repeated rows stay as they are; an
empty table gives an empty result. The columns to keep may have any name and type; where one has the name of a new column,
the new one gets leading underscores. A column that isn't named isn't read.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from fossick.llm.common import bound_batches, col, fresh, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a worker remembers, some 250 bytes each: those of the last texts, and of as many words before them; only
#: speed depends on it.
REMEMBERED = 1 << 17
#: Words that are encoded at once: the library's results take about a kilobyte a word.
LEARNT = 1 << 12


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protobuf message: number and value; nested messages stay bytes."""

    def varint(i: int) -> tuple[int, int]:
        shift = out = 0
        while True:
            c = b[i]
            i += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            v, i = varint(i)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, i = b[i : i + n], i + n
        elif kind == 2:
            n, i = varint(i)
            v, i = b[i : i + n], i + n
        else:
            raise ValueError(f"protobuf wire type {kind}")
        yield key >> 3, v


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> Model:
    m = Model()
    for n, v in fields(data):
        if n == 1:
            d = dict(fields(v))
            m.pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
        elif n == 2:
            d = dict(fields(v))
            m.kind, m.byte_fallback = d.get(3, 1), bool(d.get(35, 0))
            if d.get(24, 0):
                raise ValueError("white space as a suffix isn't supported")
        elif n == 3:
            d = dict(fields(v))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = d.get(2, b""), bool(d.get(3, 1)), bool(d.get(4, 1)), bool(d.get(5, 1))
    if m.kind not in (1, 2) or any(p[2] == UNUSED for p in m.pieces) or not m.escape:
        raise ValueError("only unigram and BPE models with escaped blanks and without unused pieces are supported")
    return m


def normaliser(m: Model) -> normalizers.Normalizer | None:
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    return normalizers.Sequence(steps) if steps else None


def backend(m: Model) -> Tokenizer:
    """The ``tokenizers`` object over normalised text with markers in it."""
    if m.kind == 2:
        rank = {p: i for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, USER)}
        score = {p: s for p, s, _ in m.pieces}
        merges = [(-score[p], i, n, p[:n], p[n:]) for p, i in rank.items() for n in range(1, len(p)) if p[:n] in rank and p[n:] in rank]
        merges.sort()
        model = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=[x[3:] for x in merges], unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        # pieces that text may not match score so low that any other cut wins
        model = models.Unigram([(p, s if k in (NORMAL, USER) else -1e4) for p, s, k in m.pieces], unk_id=m.unk, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return t


class Encoder:
    """Encodes and decodes texts with one model; ``threads`` is for each worker.

    Words are kept with blanks in place of markers: both stand for the same piece, and blanks take less memory.
    """

    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.norm = normaliser(self.model)
        self.tokenizer = backend(self.model)
        pieces = self.model.pieces
        user = sorted((p.replace(MARK, " ") for p, _, k in pieces if k == USER), key=len, reverse=True)
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in pieces if k in (NORMAL, USER))
        unit = "(?s:.+)" if crossing else " *[^ ]+| +"
        if user:
            stop = "|".join(map(re.escape, user))
            unit = f"{stop}|(?s:(?!{stop}).)+" if crossing else f"{stop}|(?:(?!{stop}) )*(?:(?!{stop})[^ ])+|(?:(?!{stop}) )+"
        self.units = re.compile(unit).findall
        self.bytes = {i for i, (_, _, k) in enumerate(pieces) if k == BYTE}
        self.control = {i for i, (_, _, k) in enumerate(pieces) if k == CONTROL}
        self.text = [p.replace(MARK, " ") for p, _, _ in pieces]
        self.user = {p.replace(MARK, " "): array("i", [i]).tobytes() for i, (p, _, k) in enumerate(pieces) if k == USER}
        self.ids: dict[str, bytes] = dict(self.user)
        self.before: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    def normalise(self, text: str) -> str:
        if self.norm is not None:
            text = self.norm.normalize_str(text)
        text = text.replace(MARK, " ")
        return " " + text if self.model.dummy_prefix and text else text

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), LEARNT):
            self._learn_some(words[i : i + LEARNT])

    def _learn_some(self, words: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w.replace(" ", MARK) for w in words], add_special_tokens=False)]
        text, special = self.text, self.bytes
        hard = []
        for w, ids in zip(words, got, strict=True):
            self.ids[w] = array("i", ids).tobytes()
            if not special.isdisjoint(ids):
                hard.append((w, ids))
            elif "".join([text[i] for i in ids]) != w:
                self.lossy.add(w)
        for (w, _), back in zip(hard, self.tokenizer.decode_batch([x for _, x in hard], skip_special_tokens=False), strict=True):
            if back != w:
                self.lossy.add(w)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes | None], list[bool | None]]:
        """Ids of each text as int32 bytes, and whether they decode to the normalised text."""
        cut = [None if t is None else self.units(self.normalise(t)) for t in texts]
        words = set().union(*[c for c in cut if c])
        if len(self.ids) > REMEMBERED // 2:
            self.ids, self.before = dict(self.user), self.ids
            self.lossy.intersection_update(self.before)
        new = words.difference(self.ids)
        known = new.intersection(self.before)
        self.ids.update(zip(known, map(self.before.__getitem__, known), strict=True))
        if new := new - known:
            self._learn(list(new))
        get, lossy = self.ids.__getitem__, self.lossy
        ids = [None if c is None else b"".join(map(get, c)) for c in cut]
        return ids, [None if c is None else not lossy or lossy.isdisjoint(c) for c in cut]

    def decode(self, ids: list[list[int] | None]) -> list[str | None]:
        """Texts of lists of ids; control ids vanish, and so does the prefix that encoding put there."""
        keep = [[i for i in x if i not in self.control] if x is not None else [] for x in ids]
        got = self.tokenizer.decode_batch(keep, skip_special_tokens=False)
        lead = self.model.dummy_prefix
        return [None if x is None else t[1:] if lead and t.startswith(" ") else t for x, t in zip(ids, got, strict=True)]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, threads: int = 2) -> Encoder:
    if (path, threads) not in _encoders:
        _encoders[path, threads] = Encoder(path, threads)
    return _encoders[path, threads]


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", threads: int = 2) -> DataFrame:
    """The columns ``keep``, then n_tokens, token_ids and round_trip: whether the ids decode to the normalised text.

    A narrow pass without shuffle.
    """
    bound_batches(docs.sparkSession)
    kept = docs.select(*[col(c) for c in keep])
    text, n_tokens, token_ids, round_trip = fresh(kept, "__text", "n_tokens", "token_ids", "round_trip")
    src = docs.select(*[col(c) for c in keep], col(text_col).cast("string").alias(text))
    schema = T.StructType([*kept.schema]).add(n_tokens, T.IntegerType()).add(token_ids, T.ArrayType(T.IntegerType())).add(round_trip, T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, threads)
        for b in slices(batches, text):
            ids, same = enc.encode(b.column(b.num_columns - 1).to_pylist())
            sizes = np.array([0 if x is None else len(x) // 4 for x in ids], np.int64)
            offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            null = np.array([x is None for x in ids])
            flat = pa.array(np.frombuffer(b"".join(x for x in ids if x), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offs), flat, mask=pa.array(null) if null.any() else None)
            yield pa.record_batch([*b.columns[:-1], pa.array(sizes, pa.int32(), mask=null), lists, pa.array(same, pa.bool_())], schema.names)

    return src.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "token_ids", threads: int = 2) -> DataFrame:
    """The columns ``keep`` and the decoded ``text``; null ids give a null text."""
    kept = encoded.select(*[col(c) for c in keep])
    ids, text = fresh(kept, "__ids", "text")
    src = encoded.select(*[col(c) for c in keep], col(ids_col).alias(ids))
    schema = T.StructType([*kept.schema]).add(text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, threads)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.record_batch([*part.columns[:-1], pa.array(enc.decode(part.column(part.num_columns - 1).to_pylist()), pa.string())], schema.names)

    return src.mapInArrow(run, schema)
