"""Line dedup: fuzzy lines by MinHash, exact Jaccard verification and distributed union-find.

A line is what stands between newlines, without white space around it; blank lines take no part and are kept. Equal
lines are one node. A node's set is that of its shingles of ``SHINGLE`` characters (a shorter line is one shingle). Two
lines are similar from a Jaccard similarity of ``JACCARD`` on, or of ``SHORT_JACCARD`` if the smaller set has ``TINY``
shingles or more, but fewer than ``SHORT``: so one changed character is found in lines of 25 characters or more, a changed
word of five letters in those of 40 or more, and a few words alone ("chapter one") must agree nearly. ``BANDS`` bands of ``ROWS`` minima make the keys of a line, ``SHORT_BANDS`` of ``SHORT_ROWS``
come on top for lines that may have a short partner. Nodes that share a key are candidates; similar ones share one with a
chance of at least 1 - (1 - 0.7**5)**16 = 0.947, short ones of 1 - (1 - 0.6**5)**16 * (1 - 0.6**4)**8 = 0.91. Keys with
the same least node are looked at together. Lines of one language share keys by chance, in proportion to the square of their
number; so every key carries a sketch, a bit of each of 63 minima, and only lines of a key whose sketches are near, directly or
through others of the key, stay together: a similar pair is lost with a chance of about 0.001 (0.003 for short lines), and
nine and more in ten of the others go before their texts are looked at. Every candidate pair is verified by its exact Jaccard
similarity, unless its lines are linked already. Of each component the occurrence in the least (doc_id, line number) stays; all others go.

Shuffled are keys, node ids and sketches (24 bytes a band), every line's text once, and the texts of candidates. A task passes a line
on once, however often it stands in its texts, so a line that a third of all texts hold comes about once from each task.

Defined results: null and empty texts have no lines; a null doc_id sorts last; a repeated row (same id, same text) keeps
the lines that its twin keeps; lines of tens of thousands of characters are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fossick.llm import bytehash as H
from fossick.llm.common import bound_batches, col, fresh, give_back, remove_table, slices, string_buffers, write_table
from fossick.llm.components import connected_components, roots

SHINGLE, BANDS, ROWS, JACCARD = 5, 16, 5, 0.7
TINY, SHORT, SHORT_BANDS, SHORT_ROWS, SHORT_JACCARD = 20, 64, 8, 4, 0.6
#: Most shingles of a line that can be similar to one with fewer than SHORT and isn't by JACCARD.
SHORT_PARTNER = int(SHORT / SHORT_JACCARD)
#: Bits of a sketch, and most different ones of similar lines: of a similarity of 0.7 some 9 of those outside the shared band
#: differ, of 0.6 (both lines short) some 12, with standard deviations of 3.
SKETCH, SKETCH_APART, SHORT_APART = 63, 17, 21
#: Rows of a key up to which all pairs of sketches are compared side by side with those of other keys.
WIDE = 32
#: Rows of a long run whose distances tell which others can be near each other.
MARKS = 8
#: Places of the table of nodes that a task has met; a power of two.
SEEN = 1 << 18
#: Bytes of lines whose hashes a processor's cache holds.
BLOCK_BYTES = 1 << 17
#: Bytes of lines whose sets a task holds at once, but for a larger group.
VERIFY_BYTES = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(5))
_A = _rng.integers(0, 1 << 31, BANDS * ROWS + SHORT_BANDS * SHORT_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number within it (from 0), byte start and end of every line that isn't blank."""
    cut = np.flatnonzero(data == 10) + 1
    bounds = H.distinct(np.concatenate([offs, cut]))
    s, e, at = H.word_spans(data, bounds)
    some = np.flatnonzero(np.diff(at))
    start = bounds[:-1][some]
    text = np.searchsorted(offs, start, side="right") - 1
    number = np.searchsorted(cut, start, side="right") - np.searchsorted(cut, offs[text], side="right")
    return text, number, s[at[some]], e[at[some + 1] - 1]


def node_ids(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return H.spans_hash(H._TABLES[1][data], s, e, 1).view(np.int64)


def _shingle_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, factor: np.unsignedinteger) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines that follow each other, one line's behind the other's, and how many each has. They
    are of the type of ``factor``. A line shorter than a shingle counts as filled up with zeros."""
    kind = type(factor)
    block = data[s[0] : e[-1]]
    s, e = s - s[0], e - s[0]
    if block.max(initial=0) < 128:
        chars = block
    else:
        place = np.concatenate([[0], np.cumsum((block & 0xC0) != 0x80)])
        chars = np.frombuffer(block.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        s, e = place[s], place[e]
    size = len(chars)
    chars = np.concatenate([chars.astype(kind), np.zeros(SHINGLE, kind)])
    h = np.zeros(size, kind)
    for k in range(SHINGLE):
        h *= factor
        h += chars[k : k + size]
    if len(tiny := np.flatnonzero(e - s < SHINGLE)):
        own = np.zeros(len(tiny), kind)
        for k in range(SHINGLE):
            own = own * factor + np.where(k < (e - s)[tiny], chars[s[tiny] + k], kind(0))
        h[s[tiny]] = own
    n = np.maximum(1, e - s - SHINGLE + 1)
    inside = np.zeros(size + 1, np.int8)
    inside[s] = 1
    inside[s + n] -= 1
    return h[np.cumsum(inside[:-1], dtype=np.int8).view(bool)], n


def _minima(h: np.ndarray, at: np.ndarray, multipliers: np.ndarray, out: np.ndarray) -> None:
    """Least products of each line's hashes, line i beginning at ``at[i]``, with every multiplier: a row of ``out`` each."""
    t = np.empty_like(h)
    for r, a in enumerate(multipliers):
        np.multiply(h, a, out=t)
        np.minimum.reduceat(t, at, out=out[r])


def _mixed(minima: np.ndarray, bands: int, first: int) -> np.ndarray:
    """(lines, bands) keys of the rows of minima; a key's last five bits are the number of its band."""
    rows = len(minima) // bands
    keys = np.empty((minima.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.zeros(minima.shape[1], np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            key = (key ^ minima[r]) * _U(0x9E3779B97F4A7C15)
            key ^= key >> _U(29)
        keys[:, b] = H.mix(key) & ~_U(31) | _U(first + b)
    return keys


def _sketches(minima: np.ndarray, short: np.ndarray) -> np.ndarray:
    """A bit of each of SKETCH rows of the minima, and above them whether a line may have a short partner."""
    out = short.astype(np.uint64) << _U(SKETCH)
    for bit, r in enumerate(np.arange(SKETCH) * len(minima) // SKETCH):
        out |= (minima[r] * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint64) << _U(bit)
    return out


def band_keys(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all lines and the line of each; the lines' sketches."""
    long, short, few = np.empty((BANDS * ROWS, len(s)), np.uint32), [np.empty((SHORT_BANDS * SHORT_ROWS, 0), np.uint32)], [np.zeros(0, np.int64)]
    # lines in order, in blocks that stay in the cache
    size = np.cumsum(e - s)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BLOCK_BYTES, side="right")))
        h, n = _shingle_hashes(data, s[i:j], e[i:j], np.uint32(0x01000193 * 31 | 1))
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        _minima(h, np.cumsum(n) - n, _A[: len(long)], long[:, i:j])
        if (own := n <= SHORT_PARTNER).any():
            m = n[own]
            few.append(i + np.flatnonzero(own))
            short.append(np.empty((SHORT_BANDS * SHORT_ROWS, len(m)), np.uint32))
            _minima(h[np.repeat(own, n)], np.cumsum(m) - m, _A[len(long) :], short[-1])
        i = j
    keys = [_mixed(long, BANDS, 0).reshape(-1), _mixed(np.concatenate(short, 1), SHORT_BANDS, BANDS).reshape(-1)]
    few = np.concatenate(few)
    brief = np.zeros(len(s), bool)
    brief[few] = True
    return np.concatenate(keys), np.concatenate([np.repeat(np.arange(len(s)), BANDS), np.repeat(few, SHORT_BANDS)]), _sketches(long, brief)


class _Seen:
    """Which nodes a task has met: each has one place in a table of fixed size, where the last of its place stands. A line
    that stands everywhere is so passed on about once a task and not once a text; one that lost its place is again."""

    def __init__(self) -> None:
        self.table = ~np.arange(SEEN)  # what no node of the place is

    def new(self, ids: np.ndarray) -> np.ndarray:
        """Where the nodes that weren't met first stand, in order."""
        at = np.sort(np.unique(ids, return_index=True)[1])
        ids = ids[at]
        place = ids & (SEEN - 1)
        at = at[self.table[place] != ids]
        self.table[place] = ids
        return at


def _emit_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Seen()
    for b in slices(batches, "text"):
        data, offs = string_buffers(b.column(0))
        _, _, s, e = line_spans(data, offs)
        ids = node_ids(data, s, e)
        at = seen.new(ids)
        keys, line, sketch = band_keys(data, s[at], e[at])
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(ids[at][line]), pa.array(sketch.view(np.int64)[line])], ["key", "node", "sketch"])


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.Array]]:
    """Columns of whole runs of the first column, by which the rows are sorted; about ``most`` rows at a time."""
    held: pa.Table | None = None
    limit = most
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= limit:
            key = held.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield [c.combine_chunks() for c in held.slice(0, end).columns]
            held = held.slice(end)
            limit = max(most, 2 * held.num_rows)
    if held is not None and held.num_rows:
        yield [c.combine_chunks() for c in held.columns]
    give_back()


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sketches are as near as those of similar lines."""
    return np.bitwise_count((x ^ y) & _U((1 << SKETCH) - 1)) <= np.where((x & y) >> _U(SKETCH), np.uint8(SHORT_APART), np.uint8(SKETCH_APART))


def _parts(begin: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """For each row the first one of its key that near sketches lead to, over others of the key too."""
    n = len(sketch)
    first = np.arange(n)
    left = np.repeat(begin + size, size) - first - 1  # rows behind this one under the same key
    i = np.flatnonzero(np.repeat(size <= WIDE, size) & (left > 0))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    d = 1
    while len(i):
        hit = i[_near(sketch[i], sketch[i + d])]
        a.append(hit)
        b.append(hit + d)
        d += 1
        i = i[left[i] >= d]
    first = roots(np.concatenate(a), np.concatenate(b), n)
    for s, m in zip(begin[size > WIDE], size[size > WIDE], strict=True):
        rest = np.arange(s, s + m)
        while len(rest):
            start, front, rest = rest[0], rest[:1], rest[1:]
            while len(front) and len(rest):
                step = max(1, min(32, (1 << 18) // len(rest)))
                hit = _near(sketch[front[:step], None], sketch[None, rest]).any(0)
                first[rest[hit]] = start
                front, rest = np.concatenate([front[step:], rest[hit]]), rest[~hit]
    return first


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the nodes of a key that near sketches hold together, if several: (their least node, node, a bit for the band), for
    the least node too."""
    for key, node, sketch in _runs(batches, 1 << 18):
        key, node, sketch = key.to_numpy(), node.to_numpy(), sketch.to_numpy().view(np.uint64)
        # rows that are alone under their key are most
        same = key[1:] == key[:-1]
        some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, node, sketch = key[some], node[some], sketch[some]
        if not len(key):
            continue
        order = np.lexsort((node, key))
        key, node, sketch = key[order], node[order], sketch[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, sketch = key[new], node[new], sketch[new]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = _parts(begin, np.diff(np.append(begin, len(key))), sketch)
        several = np.bincount(first, minlength=len(key))[first] > 1
        yield pa.record_batch([pa.array(node[first][several]), pa.array(node[several]), pa.array(np.int32(1) << (key[several] & 31).astype(np.int32))], ["grp", "node", "bands"])


def _wanted(least: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of similar lines of which the smaller set has so many shingles."""
    return np.where((least >= TINY) & (least < SHORT), SHORT_JACCARD, JACCARD)


class _Sets:
    """Shingle sets of a batch of lines: sorted 44-bit hashes, each set by itself."""

    def __init__(self, lines: pa.Array):
        data, offs = string_buffers(lines)
        h, n = _shingle_hashes(data, offs[:-1], offs[1:], _U(0x100000001B3))
        h = H.mix(h) >> _U(20)
        own = H.distinct((np.repeat(np.arange(len(n), dtype=np.uint64), n) << _U(44)) | h)
        self.at = np.searchsorted(own, np.arange(len(n) + 1, dtype=np.uint64) << _U(44))
        self.size = np.diff(self.at)
        self.hash = own & _U((1 << 44) - 1)

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets of each pair have at least the wanted Jaccard similarity."""
        out = np.zeros(len(i), bool)
        a, b = self.size[i], self.size[j]
        least = np.minimum(a, b)
        want = _wanted(least)
        able = np.flatnonzero(least >= want * np.maximum(a, b))
        work = np.cumsum(a[able] + b[able])
        k = 0
        while k < len(able):
            m = max(k + 1, int(np.searchsorted(work, (work[k - 1] if k else 0) + (1 << 21), side="right")))
            p = able[k:m]
            tag = np.arange(len(p), dtype=np.uint64) << _U(44)
            both = [np.repeat(tag, self.size[x]) | self.hash[H.ragged(self.at[x], self.size[x])] for x in (i[p], j[p])]
            t = np.sort(np.concatenate(both))
            common = np.bincount((t[1:][t[1:] == t[:-1]] >> _U(44)).astype(np.int64), minlength=len(p))
            out[p] = common >= want[p] * (a[p] + b[p] - common)
            k = m
        return out


class _Run:
    """Sets of the rows of one long run, with their hashes numbered: a table of the numbers of one set counts what it has in
    common with many others, without sorting."""

    def __init__(self, rows: np.ndarray, sets: _Sets):
        self.size = sets.size[rows]
        _, number, times = np.unique(sets.hash[H.ragged(sets.at[rows], self.size)], return_inverse=True, return_counts=True)
        # what one set alone has is common to none
        shared = times > 1
        keep = shared[number]
        self.at = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(self.size)])]
        self.number = (np.cumsum(shared, dtype=np.int32) - 1)[number[keep]]
        self.table = np.zeros(np.count_nonzero(shared), np.int32)

    def common(self, x: int, rows: np.ndarray) -> np.ndarray:
        """How many hashes row ``x`` has in common with each of ``rows``."""
        own = self.number[self.at[x] : self.at[x + 1]]
        self.table[own] = 1
        out = np.zeros(len(rows), np.int32)
        n = self.at[rows + 1] - self.at[rows]
        some = np.flatnonzero(n)
        work = np.cumsum(n[some])
        k = 0
        while k < len(some):
            m = max(k + 1, int(np.searchsorted(work, (work[k - 1] if k else 0) + (1 << 18), side="right")))
            p = some[k:m]
            out[p] = np.add.reduceat(self.table[self.number[H.ragged(self.at[rows[p]], n[p])]], np.cumsum(n[p]) - n[p])
            k = m
        self.table[own] = 0
        return out

    def alike(self, x: int, rows: np.ndarray) -> np.ndarray:
        """Whether row ``x`` and each of ``rows`` have at least the wanted Jaccard similarity."""
        out = np.zeros(len(rows), bool)
        a, b = self.size[x], self.size[rows]
        want = _wanted(np.minimum(a, b))
        able = np.flatnonzero(np.minimum(a, b) >= want * np.maximum(a, b))
        common = self.common(x, rows[able])
        out[able] = common >= want[able] * (a + b[able] - common)
        return out

    def apart(self, x: int) -> np.ndarray:
        """Jaccard distances of all rows from row ``x``."""
        common = self.common(x, np.arange(len(self.size)))
        return 1 - common / (self.size[x] + self.size - common)


def _verify_run(block: np.ndarray, rest: np.ndarray, sets: _Sets, out: list[np.ndarray]) -> None:
    """Verified links among rows of one long run, of which ``block`` is linked: what links them already is left out.

    A line of which a corpus holds many versions has a run that grows with the corpus. Most of its rows are linked by the
    first of it or by one of 32 others; only those that the largest component doesn't have are compared with all rows of
    other components, but for rows that can't be near them: Jaccard distances obey the triangle inequality."""
    rows = np.concatenate([block, rest])
    run = _Run(rows, sets)
    group = np.arange(len(rows))
    group[: len(block)] = 0
    rest = group[len(block) :].copy()
    marks = [0]
    for x in rest[:: max(1, len(rest) // 32)]:
        if group[x] != x:
            continue
        hit = run.alike(x, rest)
        if np.count_nonzero(hit) * 16 >= len(rest):
            out.append(np.stack([np.full(np.count_nonzero(hit), rows[x]), rows[rest[hit]]], 1))
            group[rest[hit]] = x
            marks.append(x)
            rest = rest[~hit]
    apart = np.stack([run.apart(x) for x in marks[:MARKS]])
    far = 1 - (SHORT_JACCARD if run.size.min() < SHORT else JACCARD) + 1e-9
    size = np.bincount(group)
    largest = size.argmax()
    for x in np.argsort(size[group], kind="stable"):
        if group[x] == largest:
            continue
        other = np.flatnonzero((group != group[x]) & (np.abs(apart - apart[:, x, None]) <= far).all(0))
        hit = other[run.alike(x, other)]
        if len(hit):
            names, at = np.unique(group[hit], return_index=True)
            out.append(np.stack([np.full(len(at), rows[x]), rows[hit[at]]], 1))
            names = np.append(names, group[x])
            group[np.isin(group, names)] = largest if largest in names else group[x]


def _verify_groups(begin: np.ndarray, size: np.ndarray, bands: np.ndarray, sets: _Sets) -> np.ndarray:
    """Verified links of all groups: first every line with the first of its group, then the pairs that this left open and
    that share a key, which has a bit in ``bands``."""
    first = np.repeat(begin, size)
    rows = np.arange(len(first))
    i, j = first[rows != first], rows[rows != first]
    good = sets.alike(i, j)
    out = [np.stack([i[good], j[good]], 1)]
    linked = rows == first
    linked[j[good]] = True
    i, j = [], []
    for s, n in zip(begin, size, strict=True):
        own = linked[s : s + n]
        if own.all():
            continue
        if n <= 24:
            x, y = np.triu_indices(n, 1)
            open_ = ~(own[x] & own[y]) & (x > 0) & (bands[s + x] & bands[s + y] != 0)
            i.append(s + x[open_])
            j.append(s + y[open_])
        else:
            _verify_run(s + np.flatnonzero(own), s + np.flatnonzero(~own), sets, out)
    if i:
        i, j = np.concatenate(i), np.concatenate(j)
        good = sets.alike(i, j)
        out.append(np.stack([i[good], j[good]], 1))
    return np.concatenate(out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group, bands, node, line in _runs(batches, 4096):
        group, bands, node = group.to_numpy(), bands.to_numpy(), node.to_numpy()
        # the node that gives the group its name comes first
        order = np.lexsort((node, group))
        bands, node, line = bands[order], node[order], line.take(pa.array(order))
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        ends = np.append(begin[1:], len(group))
        # whole groups of about VERIFY_BYTES at a time
        at = string_buffers(line)[1][np.append(begin, len(group))]
        g = 0
        while g < len(begin):
            h = max(g + 1, int(np.searchsorted(at, at[g] + VERIFY_BYTES, side="right")) - 1)
            lo, hi = begin[g], ends[h - 1]
            e = _verify_groups(begin[g:h] - lo, ends[g:h] - begin[g:h], bands[lo:hi], _Sets(line.slice(lo, hi - lo)))
            e = node[lo:hi][e].reshape(-1, 2)
            g = h
            e = e[e[:, 0] != e[:, 1]]
            if len(e):
                names, number = np.unique(e, return_inverse=True)
                number = number.reshape(-1, 2)
                r = roots(number[:, 0], number[:, 1], len(names))
                far = r != np.arange(len(names))
                yield pa.record_batch([pa.array(names[far]), pa.array(names[r[far]])], ["a", "b"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        data, offs = string_buffers(b.column(2))
        text, number, s, e = line_spans(data, offs)
        at = pa.array(text)
        yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(number, pa.int32()), pa.array(node_ids(data, s, e))], ["row", "id", "line_no", "node"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Seen()
    for b in slices(batches, "text"):
        data, offs = string_buffers(b.column(0))
        _, _, s, e = line_spans(data, offs)
        node = node_ids(data, s, e)
        at = seen.new(node)
        node, s, e = node[at], s[at], e[at]
        flat = data[H.ragged(s, e - s)]
        ends = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
        line = pa.StringArray.from_buffers(len(s), pa.py_buffer(ends), pa.py_buffer(flat.tobytes()))
        yield pa.record_batch([pa.array(node), line], ["node", "line"])


def similar_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, root) of all different lines that have a similar one."""
    bound_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    keys = text.mapInArrow(_emit_bands, "key bigint, node bigint, sketch bigint")
    members = keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_members, "grp bigint, node bigint, bands int")
    members = members.groupBy("grp", "node").agg(F.bit_or("bands").alias("bands"))
    members, path = write_table(members)
    lines = text.mapInArrow(_texts, "node bigint, line string").join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("line").alias("line"))
    pairs = members.join(lines, "node").select("grp", "bands", "node", "line").repartition(n, "grp").sortWithinPartitions("grp")
    out = connected_components(pairs.mapInArrow(_verify, "a bigint, b bigint"))
    remove_table(docs.sparkSession, path)
    return out


def _row_key(docs: DataFrame, id_col: str, text_col: str):
    return F.xxhash64(col(id_col), col(text_col))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, line_no, kept_id, kept_line): every line that goes, and the occurrence that stays for it.

    ``row`` is a hash of id and text, by which ``drop_lines`` finds the row again.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(_row_key(docs, id_col, text_col).alias("row"), col(id_col).alias("id"), col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    kind = src.schema["id"].dataType.simpleString()
    here = src.mapInArrow(_occurrences, f"row bigint, id {kind}, line_no int, node bigint")
    found, _ = write_table(similar_lines(docs, text_col))
    all_ = here.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "row", "id", "line_no")
    all_ = all_.withColumn("place", F.struct(F.col("id").isNull().alias("absent"), "id", "line_no", "row"))
    least = F.min("place").over(Window.partitionBy("root"))
    return all_.select("row", F.col("id").alias("doc_id"), "line_no", least.alias("kept"), "place").where("place > kept").select(
        "row", "doc_id", "line_no", F.col("kept.id").alias("kept_id"), F.col("kept.line_no").alias("kept_line")
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without their repeated lines, with the same columns; ``chars_col`` gets the new length.

    A document that loses all its lines stays with an empty text. Texts are shuffled once more, by row.
    """
    row, gone = fresh(docs, "__row", "__gone")
    drop = repeated_lines(docs, id_col, text_col).groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone))
    df = docs.withColumn(row, _row_key(docs, id_col, text_col)).join(drop, row, "left")
    left = F.array_join(F.filter(F.split(col(text_col), "\n", -1), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    text = F.when(F.col(gone).isNull(), col(text_col)).otherwise(left)
    out = {c: text if c == text_col else col(c) for c in docs.columns}
    if chars_col in docs.columns:
        out[chars_col] = F.when(F.col(gone).isNull(), col(chars_col)).otherwise(F.length(text)).cast(docs.schema[chars_col].dataType)
    return df.select(*[v.alias(k) for k, v in out.items()])
