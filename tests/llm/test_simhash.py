import random

import numpy as np
import pyarrow as pa

from fossick.llm import simhash as S
from fossick.llm.components import roots
from tests.llm.conftest import words

DATA = "/root/testdata/sf0.001"


def brute(rows):
    """Replaced rows by comparing the check bits of all pairs."""
    _, chk = S.fingerprints(pa.array([t or "" for _, t in rows], pa.string()))
    a, b = np.nonzero(S._apart(chk.view(np.int64)[:, None], chk.view(np.int64)[None, :]) <= S.MOST_DIFFERENT)
    r = roots(a, b, len(rows))
    least = {}
    for g, (i, _) in zip(r, rows, strict=True):
        least[g] = min(least.get(g, i), i)
    return {(i, least[g]) for g, (i, _) in zip(r, rows, strict=True) if i != least[g]}


def test_golay_code_is_perfect():
    x = np.arange(1 << 23, dtype=np.int32)
    ids = S.golay_index(x)
    assert (np.bincount(ids, minlength=4096) == 2048).all()
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 23, 2000).astype(np.int32)
    for bits in (0, 1, 2):
        b = a.copy()
        for _ in range(bits):
            b ^= (1 << rng.integers(0, 23, len(b))).astype(np.int32)
        (ka, ta), (kb, tb) = S.golay_keys(a), S.golay_keys(b)
        assert all(set(p[t]) & set(q[u]) for p, t, q, u in zip(ka, ta, kb, tb, strict=True))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {(r.doc_id, r.kept_id) for r in S.near_duplicates(docs).collect()}
    assert want and {i for i, _ in got} <= {i for i, _ in want}
    assert len(got & want) >= 0.95 * len(want)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


def test_near_copies_and_clean_ones(make):
    rng = random.Random(9)
    base = [words(rng, 150) for _ in range(60)]
    rows = [(k, t, "s") for k, t in enumerate(base)]
    rows += [(1000 + k, edited(rng, t, 6), "s") for k, t in enumerate(base)]
    rows += [(5000 + k, edited(rng, base[0], 5), "s") for k in range(1200)]
    rows += [(9000 + k, words(rng, 150), "s") for k in range(300)]
    got = {(r.doc_id, r.kept_id) for r in S.near_duplicates(make(rows)).collect()}
    copies = {(1000 + k, k) for k in range(60)} | {(5000 + k, 0) for k in range(1200)}
    assert got <= copies and len(got) >= 0.97 * len(copies)


def test_recall_up_to_the_threshold(make):
    """Of the pairs that the check accepts, nearly all share a key, however much is edited and however short the text."""
    for n, share in ((12, 2 / 12), (12, 3 / 12), (150, 0.05), (150, 0.1), (150, 0.15), (150, 0.2), (150, 0.22)):
        rng = random.Random(n)
        rows = []
        for k in range(500):
            w = words(rng, n).split()
            x = list(w)
            for i in rng.sample(range(n), round(share * n)):
                x[i] = words(rng, 1)
            rows += [(k, " ".join(w), "s"), (1000 + k, " ".join(x), "s")]
        want = brute([r[:2] for r in rows])
        got = {(r.doc_id, r.kept_id) for r in S.near_duplicates(make(rows)).collect()}
        assert want and got <= want and len(got) >= 0.95 * len(want), (n, share, len(got), len(want))


def test_plans_for_larger_corpora(make):
    """The numbers grow with the rows, and every plan finds the copies."""
    assert S.Plan.of(0) == S.Plan.of(1_000_000) == S.Plan()
    for n in (1 << 24, 10**9, 10**11):
        p = S.Plan.of(n)
        assert 12 * p.combine >= np.log2(n) and n * S.INDICES / 4096 / 2**p.second <= S.MEETING * 1.01 or p.second == 12
        assert 1 - (1 - S.JACCARD**p.band_rows) ** p.bands >= 1 - S.MISSED
    rng = random.Random(2)
    rows = []
    for k in range(300):
        t = words(rng, 150)
        rows += [(k, t, "s"), (1000 + k, edited(rng, t, rng.randint(1, 25)), "s")]
    docs, want = make(rows), brute([r[:2] for r in rows])
    for plan in (S.Plan(second=5), S.Plan(second=12), S.Plan(6, 3, 34, 5, 7)):
        got = {(r.doc_id, r.kept_id) for r in S.near_duplicates(docs, plan=plan).collect()}
        assert got <= want and len(got) >= 0.95 * len(want) > 0, plan
    # without the bands the keys of a plan are the same, whatever part of them the rows meet by
    seg, chk = S.fingerprints(pa.array([t for _, t, _ in rows]))
    pairs = []
    for second in (0, 5, 12):
        plan = S.Plan(second=second)
        flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
        b = pa.record_batch([pa.array(np.arange(len(seg))), flat(seg), flat(chk.view(np.int64)), flat(S.set_keys(pa.array([t for _, t, _ in rows])))], ["node", "seg", "chk", "sets"])
        t = pa.Table.from_batches(S._emitter(plan)(iter([b]))).sort_by("key")
        key, at = S._whole_keys(t["key"].to_numpy(), t["s0"].to_numpy()[:, None], second)
        node, found = t["node"].to_numpy()[at], set()
        for i in np.flatnonzero(key[1:] == key[:-1]):
            found.add((min(node[i], node[i + 1]), max(node[i], node[i + 1])))
        pairs.append({x for x in found if x[0] != x[1]})
    assert pairs[0] and len(pairs[0] ^ pairs[1]) <= 0.02 * len(pairs[0]) and len(pairs[0] ^ pairs[2]) <= 0.02 * len(pairs[0])


def test_check_bits_measure_the_angle_between_sets_of_words():
    """From the words alone: about arccos(cosine) / pi of the check bits differ."""
    rng = random.Random(7)
    for share in (0, 0.05, 0.1, 0.2, 0.4, 1):
        off = []
        for _ in range(60):
            a = words(rng, 150).split()
            b = [words(rng, 1) if rng.random() < share else w for w in a]
            x, y = set(a), set(b)
            angle = np.arccos(min(1, len(x & y) / np.sqrt(len(x) * len(y)))) / np.pi
            _, chk = S.fingerprints(pa.array([" ".join(a), "\n ".join(rng.sample(b, len(b)) + b[:20])]))
            off.append(int(S._apart(chk.view(np.int64)[0], chk.view(np.int64)[1])) / S.CHECK - angle)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_size_of_a_group_does_not_matter():
    """Rows of one key give the same components by pairs and by blocks."""
    rng = random.Random(5)
    for n in (30, 49, 200):
        base = [words(rng, 60) for _ in range(3)]
        texts = [edited(rng, base[k % 3], rng.randint(0, 10)) for k in range(n)]
        _, chk = S.fingerprints(pa.array(texts))
        chk = chk.view(np.int64)
        got = []
        for wide in (1, 48, 1000):
            e = S.link(np.zeros(n, np.int64), np.arange(n), chk, S.MOST_DIFFERENT, wide)
            got.append(roots(e[:, 0], e[:, 1], n).tolist())
        assert got[0] == got[1] == got[2]


def test_texts_of_one_language_do_not_share_their_segments():
    """Common words, half of each text, don't make the keys of texts that have nothing else in common."""
    rng = random.Random(4)
    common = words(rng, 8).split()
    texts = [" ".join(rng.choice(common) if rng.random() < 0.5 else words(rng, 1) for _ in range(80)) for _ in range(1500)]
    near = [edited(rng, t, 2) for t in texts[:200]]
    seg, _ = S.fingerprints(pa.array(texts + near))
    shared = np.zeros((len(seg), len(seg)), np.uint8)
    for s in seg.T:
        ids, there = S.golay_keys(np.ascontiguousarray(s))
        has = np.zeros((len(seg), 4096), np.float32)
        has[np.nonzero(there)[0], ids[there]] = 1
        shared += has @ has.T > 0
    x, y = np.triu_indices(1500, 1)
    assert np.count_nonzero(shared[x, y] >= 2) < 4000  # of 1,124,250; some 300 are expected of random segments
    assert np.mean(shared[np.arange(200), np.arange(1500, 1700)] >= 2) > 0.8


def test_keys_of_one_kind_only():
    sets = np.array([-9, -9, -4])
    ids, rows = S._whole_keys(sets, np.zeros((3, S.Plan().combine - 1), np.int32))
    assert ids.tolist() == [-9, -9, -4] and rows.tolist() == [0, 1, 2]
    ids, rows = S._whole_keys(np.array([-9, 5]), np.zeros((2, S.Plan().combine - 1), np.int32))
    assert ids[0] == -9 and (ids[1:] >= 0).all() and rows.tolist() == [0] + [1] * (len(ids) - 1)


def test_messy_and_empty(messy, nothing):
    docs, rows = messy
    got = sorted(((r.doc_id, r.kept_id) for r in S.near_duplicates(docs).collect()), key=str)
    # row 3 holds another text besides; the empty and blank ones are one group, with the null id last
    assert got == sorted([(1, 1), (2, 1), (None, 1), (5, 4), (6, 4), (None, 4)], key=str)
    kept = S.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 7, 8, 9]
    assert S.near_duplicates(nothing).count() == S.keep_one_of_each(nothing).count() == 0
