"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has two parts. ``SEGMENTS`` segments of 23 bits come from the pairs of neighbouring words as often as they
occur; they make the keys. Single words would not do: those of a language's commonest words decide most bits, so its texts
share their keys and the pairs under them grow with the square of the corpus. ``CHECK`` further bits come from the set of words; they verify. The (23, 12) Golay code is perfect: any 23-bit
word lies within 3 errors of exactly one codeword. A segment's keys are the 12-bit indices that it and its 23
neighbours decode to, at most six; two segments with at most two different bits share one of them. With four segments,
fingerprints with up to 8 different bits leave at least two segments with at most two (pigeonhole), and those with more
mostly do; so keys combine the indices of ``combine`` segments, for every choice of them. Fingerprints as far apart as
the check accepts share such a key only about every other time. Hence ``bands`` more keys come from the set of words,
each of ``band_rows`` MinHash minima: at a cosine of 0.79 sets have a Jaccard similarity of 0.62 to 0.65, and share one
of them with a chance of at least 1 - (1 - 0.62**band_rows)**bands = 0.959. Rows that share a key of either kind are
verified by the distance of their check bits, and each task links what it holds: inside a key, rows with many others
near them take those first, so that a group of thousands costs about as much as its members.

``Plan.of`` derives the numbers from that of the rows, so that the rows under one key, and those that share a key by
chance, don't grow with the corpus: ``combine`` * 12 bits are no fewer than the base-2 logarithm of the rows, with twice as
many segments; a minimum more for every eightfold corpus above a million rows, with as many bands as keep the chance; and
rows meet by their first index and as many bits of the second as leave about ``MEETING`` rows together.

Defined results: words are separated by ASCII white space; a null text counts as an empty one, and all texts without
words are copies of each other; rows with equal fingerprints are copies; of a group the row with the least doc_id stays
(null last; of repeated rows one).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fossick.llm import bytehash as H
from fossick.llm.common import bound_batches, col, fresh, remove_table, slices, string_buffers, write_table
from fossick.llm.components import connected_components, roots
from fossick.llm.lines import _runs

CHECK = 192
#: Most different check bits of near copies: about 0.21 of them, a cosine of 0.79 between sets of words.
MOST_DIFFERENT = 40
#: Jaccard similarity of sets of words that the bands must find, and how often they may miss it.
JACCARD, MISSED = 0.62, 0.041
#: Indices that a segment decodes to on average, and rows under one first index that meet in a task at once.
INDICES, MEETING = 5.2, 1 << 16
_U = np.uint64


@dataclass(frozen=True)
class Plan:
    segments: int = 4
    combine: int = 2
    bands: int = 20
    band_rows: int = 4
    second: int = 0  # bits of the second index by which rows meet

    @classmethod
    def of(cls, n: int) -> Plan:
        """For ``n`` rows."""
        n = max(2, n)
        combine = max(2, ceil(log2(n) / 12))
        band_rows = 4 + max(0, ceil(log2(n / (1 << 20)) / 3))
        bands = ceil(log(MISSED) / log(1 - JACCARD**band_rows))
        return cls(2 * combine, combine, bands, band_rows, min(12, max(0, ceil(log2(n * INDICES / 4096 / MEETING)))))

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(10))
        size = self.bands * self.band_rows
        return rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, size, dtype=np.uint32)


_GENERATOR = 0xC75


def _remainder(x: int) -> int:
    for i in range(22, 10, -1):
        if x >> i & 1:
            x ^= _GENERATOR << (i - 11)
    return x


_REST = [np.array([_remainder(b << s) if b << s < 1 << 23 else 0 for b in range(256)], np.int32) for s in (0, 8, 16)]
_ERROR = np.zeros(2048, np.int32)
for _n in (1, 2, 3):
    for _bits in combinations(range(23), _n):
        _e = sum(1 << _b for _b in _bits)
        _ERROR[_remainder(_e)] = _e


def golay_index(x: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    return (x ^ _ERROR[_REST[0][x & 255] ^ _REST[1][x >> 8 & 255] ^ _REST[2][x >> 16]]) >> 11


def golay_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of each word and its neighbours, and which of them are there: the first always is."""
    near = np.concatenate([x[:, None], x[:, None] ^ (1 << np.arange(23, dtype=np.int32))[None, :]], axis=1)
    ids = np.sort(golay_index(near), axis=1)
    first = np.ones(ids.shape, bool)
    first[:, 1:] = ids[:, 1:] != ids[:, :-1]
    out = np.zeros((len(x), 6), np.int32)
    there = np.arange(6)[None, :] < first.sum(1)[:, None]
    out[there] = ids[first]
    return out, there


_SPREAD = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def _majorities(hashes: np.ndarray, offs: np.ndarray, words: int) -> np.ndarray:
    """(texts, 64 * words) bits: whether most of a text's hashes have the bit. Counts 255 hashes at a time in byte lanes."""
    n = len(offs) - 1
    out = np.zeros((n, 64 * words), bool)
    counts = np.diff(offs)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    parts = -(-counts[full] // 255)
    starts = np.repeat(offs[:-1][full], parts) + 255 * H.ragged(np.zeros(len(full), np.int64), parts)
    text = np.concatenate([[0], np.cumsum(parts)[:-1]])
    for k in range(words):
        bits = _SPREAD[H.mix(hashes + _U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)]
        lanes = np.add.reduceat(bits, starts, axis=0).view(np.uint8).reshape(len(starts), 64)
        ones = np.add.reduceat(lanes, text, axis=0, dtype=np.int64)
        out[full, 64 * k : 64 * (k + 1)] = 2 * ones > counts[full][:, None]
    return out


def _word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of each text's different words, both with n+1 offsets of the texts into them."""
    data, offs = string_buffers(texts)
    s, e, at = H.word_spans(data, offs)
    h = H.word_hashes(data, s, e)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(at))
    own = H.distinct((doc << _U(44)) | (h >> _U(20)))
    return h, at, H.mix(own & _U((1 << 44) - 1)), np.searchsorted(own, np.arange(len(texts) + 1, dtype=np.uint64) << _U(44))


def _set_keys(own: np.ndarray, at: np.ndarray, plan: Plan) -> np.ndarray:
    """(texts, bands) keys of sets of words, all negative: those of segments aren't. 0 for a text without words."""
    out = np.zeros((len(at) - 1, plan.bands), np.int64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    h = (own >> _U(32)).astype(np.uint32)
    factors, terms = plan.multipliers()
    for b in range(plan.bands):
        key = np.full(len(full), b, np.uint64)
        for r in range(b * plan.band_rows, (b + 1) * plan.band_rows):
            key = H.mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * factors[r] + terms[r], at[:-1][full]))
        out[full, b] = (key | _U(1 << 63)).view(np.int64)
    return out


def set_keys(texts: pa.Array, plan: Plan = Plan()) -> np.ndarray:
    return _set_keys(*_word_sets(texts)[2:], plan)


def fingerprints(texts: pa.Array, segments: int = 4, check: int = CHECK) -> tuple[np.ndarray, np.ndarray]:
    """Segments (n, segments) of 23 bits and check words (n, check / 64) of each text."""
    return _fingerprints(*_word_sets(texts), segments, check)


def _neighbours(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash for each word and the one behind it in its text; the last word of a text stands alone."""
    after = np.zeros_like(h)
    after[:-1] = h[1:]
    after[at[1:][np.diff(at) > 0] - 1] = 0
    return H.mix(h * _U(0x9E3779B97F4A7C15) + after)


def _fingerprints(h: np.ndarray, at: np.ndarray, own: np.ndarray, own_at: np.ndarray, segments: int, check: int = CHECK) -> tuple[np.ndarray, np.ndarray]:
    a = _majorities(_neighbours(h, at), at, -(-23 * segments // 64))
    seg = np.stack([a[:, 23 * i : 23 * (i + 1)] @ (1 << np.arange(23)) for i in range(segments)], 1).astype(np.int32)
    b = _majorities(own, own_at, check // 64)
    return seg, np.packbits(b, axis=1, bitorder="little").view(np.uint64).reshape(len(b), check // 64)


def _node(seg: np.ndarray, chk: np.ndarray) -> np.ndarray:
    h = np.zeros(len(seg), np.uint64)
    for c in (*seg.T.astype(np.uint64), *chk.T):
        h = H.mix(h * _U(0x9E3779B97F4A7C15) + c + _U(1))
    return h.view(np.int64)


def with_fingerprints(docs: DataFrame, text_col: str, node: str, seg: str, chk: str, sets: str, keep: list[str], plan: Plan) -> DataFrame:
    """The columns ``keep``, then the id of the fingerprint, its segments, its check words and the keys of its set of words."""
    bound_batches(docs.sparkSession)
    (text,) = fresh(docs, "__text")
    src = docs.select(*[col(c) for c in keep], col(text_col).cast("string").alias(text))
    schema = src.drop(text).schema
    for n, t in ((node, T.LongType()), (seg, T.ArrayType(T.IntegerType())), (chk, T.ArrayType(T.LongType())), (sets, T.ArrayType(T.LongType()))):
        schema = schema.add(n, t)

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            w = _word_sets(b.column(b.num_columns - 1))
            s, c = _fingerprints(*w, plan.segments)
            yield pa.record_batch([*b.columns[:-1], pa.array(_node(s, c)), lists(s), lists(c.view(np.int64)), lists(_set_keys(*w[2:], plan))], schema.names)

    return src.mapInArrow(run, schema)


def _emitter(plan: Plan):
    """For every choice of segments, one row for each first index and leading bits of a second one: the rest of the key
    is worked out where the rows meet, so fingerprints aren't shuffled for each of their keys. Then one row for each key
    of the set of words."""
    shift = 12 - plan.second

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                n = b.num_rows
                seg = b.column(1).flatten().to_numpy().reshape(n, -1)
                keys = [golay_keys(np.ascontiguousarray(s)) for s in seg.T]
                rows, first, rest = [], [], []
                for number, chosen in enumerate(combinations(range(seg.shape[1]), plan.combine)):
                    k, t = keys[chosen[0]]
                    at, k = np.nonzero(t)[0], k[t].astype(np.int64)
                    if plan.second:
                        k2, t2 = keys[chosen[1]]
                        k, at = (((k[:, None] << plan.second) | (k2[at] >> shift))[t2[at]], np.repeat(at, t2.sum(1)[at]))
                        new = H.distinct(at << 24 | k)
                        at, k = new >> 24, new & ((1 << 24) - 1)
                    rows.append(at)
                    first.append((np.int64(number) << 24) | k)
                    rest.append(seg[at][:, chosen[1:]])
                rows.append(np.repeat(np.arange(n), plan.bands))
                first.append(b.column(3).flatten().to_numpy())
                rest.append(np.zeros((n * plan.bands, plan.combine - 1), np.int32))
                rows = np.concatenate(rows)
                order = np.argsort(rows, kind="stable")
                at = pa.array(rows[order])
                chk = b.column(2).flatten().to_numpy().reshape(n, -1)
                rest = np.concatenate(rest)[order]
                yield pa.record_batch(
                    [pa.array(np.concatenate(first)[order]), b.column(0).take(at), *[pa.array(np.ascontiguousarray(c)).take(at) for c in chk.T], *[pa.array(np.ascontiguousarray(c)) for c in rest.T]],
                    ["key", "node", *[f"c{j}" for j in range(chk.shape[1])], *[f"s{j}" for j in range(rest.shape[1])]],
                )

    return run


def _whole_keys(first: np.ndarray, rest: np.ndarray, second: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All keys of rows with the sorted first parts ``first`` and the segments ``rest``: keys, equal ones together, and
    their rows. A negative ``first`` is a whole key."""
    n = len(first)
    sets, first, rest = first[first < 0], first[first >= 0], rest[first >= 0]
    # rows of equal first parts, numbered: small enough to sort keys and rows as one number
    part = np.zeros(len(first), np.int64)
    part[1:] = np.cumsum(first[1:] != first[:-1])
    ids, there = part[:, None], np.ones((len(first), 1), bool)
    for number, s in enumerate(rest.T):
        k, t = golay_keys(np.ascontiguousarray(s))
        if number == 0 and second:
            t &= (k >> (12 - second)) == (first & ((1 << second) - 1))[:, None]
        wide = ids.shape[1] * k.shape[1]  # in full: there may be no rows
        ids = ((ids[:, :, None] << 12) | k[:, None, :]).reshape(len(first), wide)
        there = (there[:, :, None] & t[:, None, :]).reshape(len(first), wide)
    bits = max(1, n.bit_length())
    if len(first) and (int(part[-1]) + 1).bit_length() + 12 * rest.shape[1] + bits < 64:
        packed = np.sort((ids << bits | np.arange(len(first))[:, None])[there])
        keys, rows = packed >> bits, packed & ((1 << bits) - 1)
    else:
        keys, rows = ids[there], np.nonzero(there)[0]
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
    return np.concatenate([sets, keys]), np.concatenate([np.arange(len(sets)), len(sets) + rows])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Different bits, as bytes: a check has fewer than 256. Of a signed number numpy counts those of its absolute value."""
    out = np.bitwise_count((x[..., 0] ^ y[..., 0]).view(np.uint64))
    for k in range(1, x.shape[-1]):
        out += np.bitwise_count((x[..., k] ^ y[..., k]).view(np.uint64))
    return out


def _link_run(rest: np.ndarray, node: np.ndarray, chk: np.ndarray, most: int, out: list[np.ndarray]) -> None:
    """Edges that span the near copies among the rows ``rest`` of one key, appended to ``out``.

    Rows that have a good share of the others near them take those first, in one step each; then the others are compared
    with all rows, so only pairs inside what one row took are left out.
    """
    taken = []
    for x in rest[:: max(1, len(rest) // 32)]:
        hit = _apart(chk[rest], chk[x]) <= most
        n = np.count_nonzero(hit)
        if n * 16 >= len(rest) and n > 1:
            out.append(np.stack([np.full(n, node[x]), node[rest[hit]]], 1))
            taken.append(rest[hit])
            rest = rest[~hit]
    every = np.concatenate([rest, *taken])
    step = max(1, (1 << 20) // max(1, len(every)))
    for i in range(0, len(rest), step):
        x, y = np.nonzero(_apart(chk[rest[i : i + step], None], chk[None, every[i:]]) <= most)
        own = y > x
        out.append(np.stack([node[rest[i + x[own]]], node[every[i + y[own]]]], 1))
    # what different rows took is compared too, until a pair links them
    group = list(range(len(taken)))
    for j, block in enumerate(taken):
        for k in range(j + 1, len(taken)):
            other = taken[k]
            step = max(1, (1 << 18) // len(other))
            for i in range(0, len(block) if group[j] != group[k] else 0, step):
                x, y = np.nonzero(_apart(chk[block[i : i + step], None], chk[None, other]) <= most)
                if len(x):
                    out.append(np.array([[node[block[i + x[0]]], node[other[y[0]]]]]))
                    group = [group[j] if g == group[k] else g for g in group]
                    break


def link(key: np.ndarray, node: np.ndarray, chk: np.ndarray, most: int, wide: int = 48) -> np.ndarray:
    """Edges (node, node) that span the near copies inside every key; ``key`` is sorted and its keys are whole."""
    if not len(key):
        return np.zeros((0, 2), np.int64)
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    begin = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([begin, [len(key)]]))
    out = []
    small = np.repeat(size <= wide, size)
    left = np.repeat(begin + size, size) - np.arange(len(key)) - 1  # rows behind this one under the same key
    for d in range(1, int(min(wide, size.max(initial=1)))):
        i = np.flatnonzero(small & (left >= d))
        if not len(i):
            break
        i = i[_apart(chk[i], chk[i + d]) <= most]
        out.append(np.stack([node[i], node[i + d]], 1))
    for s, n in zip(begin[size > wide], size[size > wide], strict=True):
        _link_run(np.arange(s, s + n), node, chk, most, out)
    if not out:
        return np.zeros((0, 2), np.int64)
    e = np.concatenate(out)
    e = e[e[:, 0] != e[:, 1]]
    if not len(e):
        return e
    names, at = np.unique(e, return_inverse=True)
    at = at.reshape(-1, 2)
    r = roots(at[:, 0], at[:, 1], len(names))
    far = r != np.arange(len(names))
    return np.stack([names[far], names[r[far]]], 1)


def _linker(plan: Plan):
    """Links rows sorted by the first parts of their keys."""
    words = CHECK // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches, 1 << 16):
            x = [c.to_numpy(zero_copy_only=False) for c in cols]
            key, rows = _whole_keys(x[0], np.stack(x[2 + words :], 1), plan.second)
            # keys of one row link nothing
            same = key[1:] == key[:-1]
            several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            key, rows = key[several], rows[several]
            e = link(key, x[1][rows], np.stack(x[2 : 2 + words], 1)[rows], MOST_DIFFERENT)
            if len(e):
                yield pa.record_batch([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def near_copies(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(node, root) of all fingerprints (node, seg, chk, sets), made by ``plan``, that have a near copy."""
    words = "".join(f", c{j} bigint" for j in range(CHECK // 64)) + "".join(f", s{j} int" for j in range(plan.combine - 1))
    keys = nodes.select("node", "seg", "chk", "sets").mapInArrow(_emitter(plan), "key bigint, node bigint" + words)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_linker(plan), "a bigint, b bigint")
    return connected_components(edges)


def _distinct_fingerprints(rows: DataFrame, order: list) -> DataFrame:
    """One row a fingerprint, with the least of its rows by ``order``."""
    return rows.groupBy("node").agg(F.first("seg").alias("seg"), F.first("chk").alias("chk"), F.first("sets").alias("sets"), F.min(F.struct(*order)).alias("least"), F.count("*").alias("n"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan | None = None) -> DataFrame:
    """(doc_id, kept_id): every row that a near copy replaces, and the document that stays for its group.

    Shuffled are fingerprints and keys, never texts. A row with a null id can be replaced; kept_id is null where a group
    has no other ids. Without a ``plan`` rows are counted first.
    """
    plan = plan or Plan.of(docs.count())
    ided = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    rows, _ = write_table(with_fingerprints(ided, "text", "node", "seg", "chk", "sets", ["id"], plan))
    nodes = _distinct_fingerprints(rows, [F.col("id").isNull().alias("absent"), F.col("id").alias("id")])
    found, _ = write_table(near_copies(nodes, plan))
    groups = rows.select("id", "node").join(found, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    w = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last())
    ranked = groups.select("id", F.row_number().over(w).alias("place"), F.first("id").over(w).alias("kept_id"))
    return ranked.where("place > 1").select(F.col("id").alias("doc_id"), "kept_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies, with the same columns. Texts are shuffled once."""
    plan = plan or Plan.of(docs.count())
    node, seg, chk, sets, least = fresh(docs, "__node", "__seg", "__chk", "__sets", "__least")
    rows = with_fingerprints(docs, text_col, node, seg, chk, sets, docs.columns, plan)
    small = rows.select(col(id_col).alias("id"), F.col(node).alias("node"), F.col(seg).alias("seg"), F.col(chk).alias("chk"), F.col(sets).alias("sets"))
    nodes, nodes_path = write_table(_distinct_fingerprints(small, [F.col("id").isNull().alias("absent"), F.col("id").alias("id")]))
    found, found_path = write_table(near_copies(nodes, plan))
    mine = nodes.select("node", "least").join(found, "node", "left").select("node", F.struct("least", "node").alias("rank"), F.coalesce("root", "node").alias("root"))
    stays, _ = write_table(mine.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.node").alias(node)))
    for path in (nodes_path, found_path):
        remove_table(docs.sparkSession, path)
    w = Window.partitionBy(F.col(node)).orderBy(col(id_col).asc_nulls_last())
    return rows.drop(seg, chk, sets).join(stays, node).withColumn(least, F.row_number().over(w)).where(F.col(least) == 1).select(*[col(c) for c in docs.columns])
