import random
from collections import defaultdict

import numpy as np

from fossick.llm import lines as L
from fossick.llm.components import roots
from tests.llm.conftest import words

DATA = "/root/testdata/sf0.001"
BLANK = " \t\n\r\x0b\x0c"


def shingles(line):
    return {line[i : i + L.SHINGLE] for i in range(max(1, len(line) - L.SHINGLE + 1))}


def brute(rows):
    """(component of every different line, occurrences) by comparing all pairs."""
    where = defaultdict(list)
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if x.strip(BLANK):
                where[x.strip(BLANK)].append((i is None, i, n))
    names = list(where)
    sets = [shingles(x) for x in names]
    a, b = [], []
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    seen = set()
    for ids in index.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    least = L.SHORT_JACCARD if L.TINY <= min(len(sets[i]), len(sets[j])) < L.SHORT else L.JACCARD
                    if both >= least * (len(sets[i]) + len(sets[j]) - both):
                        a.append(i)
                        b.append(j)
    r = roots(np.array(a, np.int64), np.array(b, np.int64), len(names))
    groups = defaultdict(list)
    for name, g in zip(names, r, strict=True):
        groups[g] += where[name]
    out = {}
    for places in groups.values():
        least = min(places, key=lambda p: (p[0], p[1] or 0, p[2]))
        for p in places:
            if p != least:
                out[p[1], p[2]] = (least[1], least[2])
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {(r.doc_id, r.line_no): (r.kept_id, r.kept_line) for r in L.repeated_lines(docs).collect()}
    assert want and set(got) <= set(want)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.95 * len(want)


def edited(rng, line, n):
    w = line.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


def test_fuzzy_groups(make):
    rng = random.Random(5)
    bases = [words(rng, 40) for _ in range(30)]
    rows = [(i, "\n".join([words(rng, 30), edited(rng, bases[i % 30], 2), words(rng, 30)]), "s") for i in range(1500)]
    docs = make(rows)
    got = {(r.doc_id, r.line_no) for r in L.repeated_lines(docs).collect()}
    want = set(brute([(i, t) for i, t, _ in rows]))
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 1000


def changed(rng, line, how):
    """The line with one character, or one word of at most five letters, changed."""
    if how == "character":
        i = rng.randrange(len(line))
        return line[:i] + rng.choice([c for c in "0123456789" if c != line[i]]) + line[i + 1 :]
    w = line.split()
    i = rng.choice([k for k, x in enumerate(w) if len(x) <= 5])
    w[i] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in w[i])
    return " ".join(w)


def test_short_lines_with_one_edit(make):
    rng = random.Random(9)
    rows, n = [], 0
    for size in (30, 40, 50, 60, 75, 90):
        for how in ("character", "word"):
            for _ in range(60):
                line = words(rng, 20)[: size - 5] + " abcd"
                if how == "character" or size >= 40:
                    rows += [(2 * n, line, "s"), (2 * n + 1, changed(rng, line, how), "s")]
                    n += 1
    rows += [(2 * n, "Copyright (c) 2020 Example Corp. All rights reserved.", "s"), (2 * n + 1, "Copyright (c) 2021 Example Corp. All rights reserved.", "s")]
    got = {(r.doc_id, r.kept_id) for r in L.repeated_lines(make(rows)).collect()}
    assert all(a == b + 1 and b % 2 == 0 for a, b in got)
    assert (2 * n + 1, 2 * n) in got
    for i in range(0, n, 60):
        assert sum((2 * k + 1, 2 * k) in got for k in range(i, i + 60)) >= 54


def test_size_of_a_group_does_not_matter():
    """Small groups are verified pair by pair, others by blocks: with the same components, those of all pairs."""
    rng = random.Random(3)
    for n in (24, 25, 60):
        bases = [words(rng, 12) for _ in range(4)]
        names = sorted({edited(rng, bases[k % 4], rng.randint(0, 2)) for k in range(n)})
        sets = L._Sets(L.pa.array(names))
        x, y = np.triu_indices(len(names), 1)
        good = sets.alike(x, y)
        want = roots(x[good], y[good], len(names))
        every = np.arange(len(names))
        out = [np.zeros((0, 2), np.int64)]
        L._verify_run(every[:1], every[1:], sets, out)
        e = np.concatenate(out)
        assert (roots(e[:, 0], e[:, 1], len(names)) == want).all()
        e = L._verify_groups(np.array([0]), np.array([len(names)]), np.ones(len(names), np.int32), sets)
        assert (roots(e[:, 0], e[:, 1], len(names)) == want).all()


def test_versions_of_a_line_are_sorted_with_each_other_about_once(monkeypatch):
    """A run of versions of one line grows with the corpus: with the right components, its sets aren't sorted pair by pair."""
    rng = random.Random(2)
    base, other = words(rng, 60), words(rng, 60)
    sorted_pairs, alike = [], L._Sets.alike
    monkeypatch.setattr(L._Sets, "alike", lambda self, i, j: sorted_pairs.append(len(i)) or alike(self, i, j))
    for n in (300, 1200):
        names = [base, *sorted({edited(rng, base, rng.randint(1, 11)) for _ in range(n)} | {edited(rng, other, rng.randint(0, 9)) for _ in range(n // 10)} | {words(rng, 5 * k) for k in range(1, 9)})]
        sets = L._Sets(L.pa.array(names))
        sorted_pairs.clear()
        e = L._verify_groups(np.array([0]), np.array([len(names)]), np.ones(len(names), np.int32), sets)
        assert sum(sorted_pairs) <= 2 * len(names), (n, sum(sorted_pairs))
        if n == 300:
            x, y = np.triu_indices(len(names), 1)
            good = alike(sets, x, y)
            want = roots(x[good], y[good], len(names))
            assert 9 < len(set(want)) < 0.5 * n and good[x == 0].sum() < 0.9 * n
            assert (roots(e[:, 0], e[:, 1], len(names)) == want).all()


def test_a_task_passes_on_a_line_once():
    rng = random.Random(6)
    texts = [f"{words(rng, 12)}\nthis boilerplate stands in every text of the table\n{words(rng, 12)}" for _ in range(3000)]
    batches = [L.pa.record_batch([L.pa.array(texts[i : i + 100])], ["text"]) for i in range(0, 3000, 100)]
    lines = [x for b in L._texts(iter(batches)) for x in b.column(1).to_pylist()]
    assert len(lines) < 6001 + 50 and len(set(lines)) == 6001
    nodes = np.concatenate([b.column(1).to_numpy() for b in L._emit_bands(iter(batches))])
    assert len(np.unique(nodes)) == 6001


def test_lines_that_share_a_key_by_chance_go_before_their_texts_are_read():
    """Of lines in a language of few syllables, nearly only those with a similar one are members of a group."""
    rng = random.Random(8)
    syllables = ["the", "an", "ing", "tion", "er", "ou", "nd", "sh", "ha", "ble", "ly", "st", "in", "or", "wh", "ed"]
    line = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    names = [line(rng.randint(20, 60)) for _ in range(6000)]
    copies = [edited(rng, x, 1) for x in names[:300]]
    b = L.pa.record_batch([L.pa.array(["\n".join(names), "\n".join(copies)])], ["text"])
    keys = L.pa.Table.from_batches(list(L._emit_bands(iter([b])))).sort_by("key")
    members = L.pa.Table.from_batches(list(L._members(iter(keys.to_batches())))).to_pandas()
    data, offs = L.string_buffers(L.pa.array(names + copies))
    node = L.node_ids(data, offs[:-1], offs[1:])
    chance = set(members.node) & set(node[300:6000])
    assert len(chance) < 150, len(chance)
    groups = members.groupby("node").grp.agg(set)
    alike = L._Sets(L.pa.array(names + copies)).alike(np.arange(300), np.arange(6000, 6300))
    met = [bool(groups.get(node[k], set()) & groups.get(node[6000 + k], set())) for k in range(300)]
    assert alike.sum() > 250 and np.mean(np.array(met)[alike]) >= 0.97


def test_parts_of_a_key():
    """Near sketches hold rows together, over others too; keys of any size are treated alike."""
    rng = np.random.Generator(np.random.PCG64(1))
    bit = lambda *k: np.bitwise_or.reduce([np.uint64(1) << np.uint64(i) for i in k])
    for copies in (2, 40):
        base = rng.integers(0, 1 << 63, copies * 4, dtype=np.uint64)
        base[1] = base[0] ^ bit(*range(17))
        base[2] = base[1] ^ bit(*range(17, 34))
        base[3] = base[0] ^ bit(*range(40, 63))
        begin, size = np.array([0, len(base)]), np.array([len(base), len(base)])
        x, y = np.nonzero(L._near(base[:, None], base[None, :]))
        want = roots(x, y, len(base))
        assert want[2] == 0 and not L._near(base[0], base[2])
        assert (L._parts(begin, size, np.concatenate([base, base])) == np.concatenate([want, want + len(base)])).all()
    low = bit(*range(21))
    assert not L._near(low, bit(62) ^ bit(62)) and L._near(low | bit(63), bit(63)) and not L._near(low | bit(63), bit(62) ^ bit(62))


def test_drop_lines(make):
    rows = [(1, "a line that is kept\nanother line here", "s"), (2, "  a line that is kept \n\nown line of two", "s"), (None, "another line here", "s"), (3, "own line of three\n\n", "s")]
    got = {r.doc_id: r for r in L.drop_lines(make(rows)).collect()}
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "\nown line of two", None: "", 3: rows[3][1]}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_messy_and_empty(messy, nothing):
    docs, rows = messy
    got = L.drop_lines(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    text = {(r.doc_id): r.text for r in got.collect()}
    first = next(t for i, t, _ in rows if i == 1)
    assert text[1] == first and text[2] == "" and text[4] is None and text[5] == "" and text[3].count("\n") == 0
    assert text[7] == next(t for i, t, _ in rows if i == 7)
    assert L.repeated_lines(nothing).count() == L.drop_lines(nothing).count() == 0
