"""Evidence of a document for a query: sampled windows, scored, refined around the best, joined to snippets.

The rounds of a document are worked out inside an Arrow batch, with a random generator
seeded by its path, so a run can be repeated. Documents below ``WHOLE`` characters are evidence as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHOLE, SIZE, STRIDE, ROUNDS = 100_000, 500, 250, 3
ANCHORS, EXPLORE, PER_ROUND, SEEDS, LEAST_SCORE = 5, 2, 5, 2, 4.0


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bits of one number for the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        if m := at.get(c):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def token_set_score(a: str, words: set[str]) -> float:
    """Token-set ratio of a text and the wanted words, 0 to 100: 100 if either holds all of the other's; else the best of
    three similarities, each 2 * common / total characters: of the common words to either side, and of both sides, where
    the words that aren't common are compared by their longest common subsequence."""
    have = set(a.lower().split())
    if not have or not words:
        return 0.0
    both, left, right = have & words, " ".join(sorted(have - words)), " ".join(sorted(words - have))
    if both and (not left or not right):
        return 100.0
    n = len(" ".join(both))
    gap = int(bool(n))
    total = 2 * (n + gap) + len(left) + len(right)
    best = 100 - 100 * (len(left) + len(right) - 2 * _common(left, right)) / total
    for side in (left, right) if n else ():
        best = max(best, 100 - 100 * (gap + len(side)) / (2 * n + gap + len(side)))
    return best


def fragments(found: DataFrame, files: DataFrame, *, around: int = 1000) -> DataFrame:
    """(path, context): the best windows (path, start, end) of each file, ``around`` characters on both sides of their
    centres, in the order of the text, each under a heading with its number."""
    centre = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    lo = F.greatest(F.lit(0), centre - around)
    cut = found.select("path", "start", lo.alias("lo"), (centre + around - lo).alias("size")).join(files.select("path", "content"), "path")
    parts = F.array_sort(F.collect_list(F.struct("start", F.expr("substring(content, lo + 1, size)").alias("t"))))
    shown = F.transform(parts, lambda p, i: F.concat(F.lit("\n--- Context Fragment "), (i + 1).cast("string"), F.lit(" ---\n..."), p["t"], F.lit("...\n")))
    return cut.groupBy("path").agg(F.array_join(shown, "").alias("context"))


def sample_document(path: str, text: str, words: set[str], *, threshold: float = 8.0, whole: int = WHOLE, top_k: int = 5) -> list[tuple[int, int, float, int]]:
    """(start, end, score 0-10, round) of the best windows, best first; a short document is one window of score 10."""
    n = len(text)
    if n == 0:
        return []
    if n < whole:
        return [(0, n, 10.0, 0)]
    rng = np.random.default_rng(zlib.crc32(path.encode()))
    score = lambda s: token_set_score(text[s : s + SIZE], words) / 10
    clamp = lambda s: int(min(max(0, s), n - SIZE))
    got: dict[int, tuple[float, int]] = {}

    def visit(start: int, number: int, apart: int) -> bool:
        start = clamp(start)
        if any(abs(start - s) < apart for s in got):
            return False
        got[start] = (score(start), number)
        return True

    ranked = sorted(((token_set_score(text[s : s + SIZE], words), -s) for s in range(0, n, STRIDE)), reverse=True)[: 2 * ANCHORS]
    anchors = [clamp(-s) for v, s in ranked if v >= 10][:ANCHORS]
    for s in anchors:
        got.setdefault(s, (score(s), 1))

    def stratified(count: int, number: int) -> None:
        step = n // count
        for i in range(count):
            visit(int(rng.integers(i * step, max(i * step, (i + 1) * step - SIZE) + 1)), number, SIZE // 2)

    stratified(EXPLORE if anchors else 5, 1)
    for number in range(2, ROUNDS + 1):
        best = sorted(got.items(), key=lambda x: (-x[1][0], x[0]))
        if best and best[0][1][0] >= threshold:
            break
        seeds = [s for s, (v, _) in best[:SEEDS] if v >= LEAST_SCORE]
        if not seeds:
            stratified(PER_ROUND, number)
            continue
        sigma = n / 20 / 2 ** (number - 1)
        left = PER_ROUND
        for i, s in enumerate(seeds):
            for _ in range(max(1, ceil(left / (len(seeds) - i)))):
                if left and visit(int(rng.normal(s + SIZE / 2, sigma)) - SIZE // 2, number, SIZE // 3):
                    left -= 1
    best = sorted(((s, min(n, s + SIZE), v, r) for s, (v, r) in got.items()), key=lambda x: (-x[2], x[0]))
    good = [x for x in best if x[2] >= LEAST_SCORE]
    return good[:top_k] if good else best[:1]


def evidence(files: DataFrame, words: list[str], *, threshold: float = 8.0, whole: int = WHOLE, top_k: int = 5) -> DataFrame:
    """(path, start, end, score, round, is_found, snippet) of files (path, content)."""
    wanted = {w.lower() for w in words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "start", "end", "score", "round", "is_found", "snippet"]
        for b in batches:
            rows = [(p, s, e, v, r, v >= LEAST_SCORE, t[s:e]) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for s, e, v, r in sample_document(p, t, wanted, threshold=threshold, whole=whole, top_k=top_k)]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.bool_(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, "path string, start int, end int, score double, round int, is_found boolean, snippet string")


#: Phrases are ranked for so many words at once, or one longer document; words are forgotten beyond so many.
WORDS_AT_ONCE, WORDS_KNOWN, PAIRS_AT_ONCE = 50_000, 50_000, 512
STOP = frozenset("the a an of and or to in is are be was on for with as it that this by at from".split())


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ 0xEDB88320, t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def _trigram_hashes(*chars: np.ndarray) -> np.ndarray:
    """The CRC-32 modulo 256 of the UTF-8 bytes of trigrams, given as arrays of their first, second and third code points."""
    s = np.full(len(chars[0]), 0xFFFFFFFF, np.uint32)

    def step(s: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return _CRC[(s ^ byte) & 255] ^ s >> 8

    for c in chars:
        wide = np.flatnonzero(c > 127)
        if len(wide):
            t, x = s[wide], c[wide]
            for size, least, most in ((2, 0x80, 0x800), (3, 0x800, 0x10000), (4, 0x10000, 0x110000)):
                of = np.flatnonzero((x >= least) & (x < most))
                if len(of):
                    y, u = x[of], t[of]
                    u = step(u, y >> 6 * (size - 1) | (0xF00 >> size & 0xFF))
                    for k in range(size - 2, -1, -1):
                        u = step(u, y >> 6 * k & 63 | 128)
                    t[of] = u
        s = step(s, c)
        if len(wide):
            s[wide] = t
    return (~s & 255).astype(np.uint8)


class _Words(dict):
    """Numbers of words, and what phrases need to know of each once ``learn`` has run: the hashes of its trigrams with the
    blanks around it (``flat``, from ``ends[n]`` to ``ends[n + 1]``), the sum of their squared counts, its first and last
    character, whether it is a phrase by itself and whether it is passed over."""

    def __init__(self, stop: frozenset[str]):
        self.stop, self.names = stop, []
        self.flat, self.ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.square, self.first, self.last, self.long, self.stopped = (np.zeros(0, k) for k in (np.int64, np.uint32, np.uint32, bool, bool))

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self.names)
        self.names.append(w)
        return n

    def learn(self) -> None:
        new = self.names[len(self.square) :]
        if not new:
            return
        size = np.array([len(w) for w in new])  # as many trigrams as characters
        c = np.frombuffer(f" {'  '.join(new)} ".encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(new)), size)
        at = np.arange(len(word)) + 2 * word
        g = _trigram_hashes(c[at], c[at + 1], c[at + 2])
        same, counts = np.unique(word * 256 + g, return_counts=True)
        end = np.cumsum(size)
        add = {
            "flat": g, "ends": self.ends[-1] + end, "square": np.bincount(same >> 8, counts**2, len(new)).astype(np.int64), "first": c[at[end - size] + 1], "last": c[at[end - 1] + 1],
            "long": size > 1, "stopped": np.array([w in self.stop for w in new]),
        }
        for k, v in add.items():
            setattr(self, k, np.concatenate([getattr(self, k), v]))


def _rank_phrases(found: list[list[int]], words: _Words, top_k: int, diversity: float) -> list[list[tuple[str, float]]]:
    """(phrase, similarity) of the chosen phrases of each document, given as the numbers of its words.

    The counts of "a b" are those of a and of b and one trigram that bridges them, so products with a document's or a
    phrase's counts are sums over words, in whole numbers. Every occurrence of a phrase has its place in the arrays.
    """
    out: list[list[tuple[str, float]]] = [[] for _ in found]
    w = np.fromiter(chain.from_iterable(found), np.int64)
    home = np.repeat(np.arange(len(found)), [len(f) for f in found])
    words.learn()
    stay = ~words.stopped[w]
    w, home = w[stay], home[stay]
    if not len(w):
        return out
    ids, begin, doc = np.unique(home, return_index=True, return_inverse=True)
    flat, ends = words.flat, words.ends
    pair = np.append(doc[1:] == doc[:-1], False)
    p = np.flatnonzero(pair)

    def grams(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, where each word's begin, and the trigrams of the words one after the other."""
        size = ends[number + 1] - ends[number]
        at = np.cumsum(size) - size
        return size, at, flat[np.repeat(ends[number] - at, size) + np.arange(size.sum())]

    size, at, g = grams(w)
    bridge = _trigram_hashes(words.last[w[p]], np.full(len(p), 32, np.uint32), words.first[w[p + 1]])
    at_doc, at_bridge = np.repeat(doc * 256, size) + g, doc[p] * 256 + bridge

    one = words.square[w]
    two = one[p] + one[p + 1] + 1
    for lo in range(0, len(p), PAIRS_AT_ONCE):
        q, br = p[lo : lo + PAIRS_AT_ONCE], bridge[lo : lo + PAIRS_AT_ONCE]
        row = np.arange(len(q)) * 256
        n, _, second = grams(w[q + 1])
        counts = np.bincount(np.repeat(row, n) + second, minlength=256 * len(q))
        n, start, before = grams(w[q])
        shared = np.add.reduceat(counts[np.repeat(row, n) + before] + (before == np.repeat(br, n)), start)
        two[lo : lo + PAIRS_AT_ONCE] += 2 * (shared + counts[row + br])

    def products(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.add.reduceat(counts[at_doc], at)
        return x, x[p] + x[p + 1] + counts[at_bridge]

    whole = np.bincount(np.concatenate([at_doc, at_bridge]), minlength=256 * len(ids))
    norm = (whole.reshape(-1, 256) ** 2).sum(axis=1)
    a, b = products(whole)
    sim = np.zeros((2, len(w)))
    sim[0], sim[1, p] = a / np.sqrt(one * norm[doc]), b / np.sqrt(two * norm[doc[p]])
    square_of = np.ones((2, len(w)), np.int64)
    square_of[0], square_of[1, p] = one, two
    bridge_of = np.zeros(len(w), np.int64)
    bridge_of[p] = bridge
    left, best = np.array([words.long[w], pair]), np.zeros((2, len(w)))
    for k in range(top_k):
        value = np.where(left, sim if k == 0 else (1 - diversity) * sim - diversity * best, -np.inf)
        top = np.maximum.reduceat(value.max(axis=0), begin)
        kind, place = np.nonzero((value == top[doc]) & left)
        if not len(place):
            break
        tied: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for d, two_words, i in zip(doc[place].tolist(), kind.tolist(), place.tolist(), strict=True):
            name = words.names[w[i]]
            tied.setdefault(d, {}).setdefault(f"{name} {words.names[w[i + 1]]}" if two_words else name, []).append((two_words, i))
        chosen = []
        for d, phrases in tied.items():
            where = phrases[name := min(phrases)]
            out[ids[d]].append((name, round(float(sim[where[0]]), 6)))
            left[tuple(zip(*where, strict=True))] = False
            chosen.append((d, *where[0]))
        if k + 1 == top_k:
            break
        d, two_words, i = np.array(chosen).T
        twice = two_words == 1
        d2, i2 = d[twice], i[twice]
        n, _, x = grams(np.concatenate([w[i], w[i2 + 1]]))
        counts = np.bincount(np.concatenate([np.repeat(np.concatenate([d, d2]) * 256, n) + x, d2 * 256 + bridge_of[i2]]), minlength=256 * len(ids))
        of = np.ones(len(ids), np.int64)
        of[d] = square_of[two_words, i]
        a, b = products(counts)
        best[0] = np.maximum(best[0], a / np.sqrt(one * of[doc]))
        best[1, p] = np.maximum(best[1, p], b / np.sqrt(two * of[doc[p]]))
    return out


def key_phrases(files: DataFrame, *, top_k: int = 20, diversity: float = 0.5, stop: frozenset[str] = STOP) -> DataFrame:
    """(path, place, phrase, score): one- and two-word phrases by similarity to the document, made diverse.

    Vectors are hashed counts of character trigrams; the first phrase is the most similar, then each is the best of
    (1 - d) * similarity - d * the greatest similarity to those chosen; of equal ones the first by characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(stop)
        find = re.compile(r"\w+").findall
        kinds = (pa.string(), pa.int32(), pa.string(), pa.float64())
        for b in batches:
            paths, found, n = [], [], 0
            for i in range(b.num_rows):
                if t := b.column(1)[i].as_py():
                    paths.append(b.column(0)[i].as_py())
                    found.append([words[x] for x in find(t.lower())])
                    n += len(found[-1])
                if n < WORDS_AT_ONCE and i + 1 < b.num_rows:
                    continue
                rows = [(path, k + 1, w, v) for path, chosen in zip(paths, _rank_phrases(found, words, top_k, diversity), strict=True) for k, (w, v) in enumerate(chosen)]
                paths, found, n = [], [], 0
                if len(words) > WORDS_KNOWN:
                    words = _Words(stop)
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "place", "phrase", "score"])

    return files.select("path", "content").mapInArrow(run, "path string, place int, phrase string, score double")


def snapshot_lines(lines: DataFrame, *, budget: int = 2048) -> DataFrame:
    """(path, line_number, line, tokens): lines that say something, sampled in order under a token budget for each file.

    While at most 70 % of the budget is used every line is taken; then with a chance that falls as it fills, at most
    150 %; from 120 % on none. The chance comes from a hash of path and line number. Lines pass by in order, none of a
    file is held.
    """
    from fossick.functions.text import is_noise

    tokens = F.greatest(F.lit(1), F.floor(F.length("line") / 4)).cast("int").alias("tokens")
    good = lines.where(~is_noise(F.col("line"))).select(F.col("path").cast("string").alias("path"), F.col("line_number").cast("int").alias("line_number"), "line", tokens)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, used = object(), 0
        for b in batches:
            keep = []
            for q, n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if q != path:
                    path, used = q, 0
                take = used == 0 or used + t <= 0.7 * budget
                if not take and used < 1.2 * budget and used + t <= 1.5 * budget:
                    fill = used / budget
                    u = zlib.crc32(f"{q}:{n}".encode()) / 2**32
                    w = zlib.crc32(f"{n}:{q}".encode()) / 2**32
                    p = max(0.2, 1 - 2 * fill) * (min(1.0, 0.8 + 0.4 * (1 - t / budget)) if fill > 0.5 else 1.0) * (0.8 + 0.4 * w)
                    take = u < min(1.0, p)
                if take:
                    used += t
                keep.append(take)
            yield b.filter(pa.array(keep, pa.bool_()))

    return good.repartition("path").sortWithinPartitions("path", F.asc_nulls_last("line_number")).mapInArrow(pick, "path string, line_number int, line string, tokens int")
