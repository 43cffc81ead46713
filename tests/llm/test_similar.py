"""Near copies by Jaccard similarity of five-word shingles, against brute force over all pairs."""

import random

import numpy as np
import pytest

from geoplane.llm import similar

DOCS = "doc_id bigint, text string, row int, print string, root string"


def grams(text, words=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_roots(rows, similarity=0.8):
    """The least row that links reach, of rows (id, text)."""
    sets, root = {d: grams(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = {}
    for d in sets:
        for g in sets[d]:
            holders.setdefault(g, []).append(d)
    for d in sorted(sets):
        for e in {e for g in sets[d] for e in holders[g] if e > d} | {e for e in sets if e > d and not sets[e] and not sets[d]}:
            both = len(sets[d] & sets[e])
            if both >= similarity * (len(sets[d]) + len(sets[e]) - both) - 1e-9:
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def changed(words, rng, share):
    return [rng.choice(["new", "other", "third"]) + str(rng.randrange(999)) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(1)
    rows, base = [], None
    for i in range(400):
        if i % 4 == 0:
            base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 12, 60, 300]))]
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(changed(base, rng, rng.choice([0.0, 0.005, 0.01, 0.02, 0.2])))))
    hot = [f"h{rng.randrange(3000)}" for _ in range(200)]
    return rows + [(1000 + i, " ".join(changed(hot, rng, 0.01))) for i in range(300)]


@pytest.mark.parametrize("limit", [2000, 40])
def test_brute_force(spark, near_rows, limit):
    docs = spark.createDataFrame([(*r, 0, "x", "y") for r in near_rows], DOCS)
    got = {r.doc_id for r in similar.keep_one(docs, limit=limit).select("doc_id").collect()}
    roots = brute_roots(near_rows)
    want = {d for d, r in roots.items() if d == r}
    # a group that the index splits keeps one row of each part: none is lost, few stay besides
    assert want <= got and len(got - want) <= 0.02 * (len(near_rows) - len(want))


def test_recall_by_similarity():
    """Random sums of signs at a given similarity: how many pairs share a key and pass for near."""
    rng = np.random.default_rng(0)
    for similarity, least in ((0.8, 0.83), (0.85, 0.95), (0.9, 0.99)):
        c = 2 * similarity / (1 + similarity)
        x = rng.standard_normal((400, 1024))
        y = c * x + np.sqrt(1 - c * c) * rng.standard_normal(x.shape)
        (p, k), (q, m) = similar.fingerprint_keys(x), similar.fingerprint_keys(y)
        found = [bool(set(k[i]) & set(m[i])) and similar._near(p[i : i + 1], q[i])[0] for i in range(len(x))]
        assert np.mean(found) >= least


def test_exact_check(spark):
    docs = spark.createDataFrame([(0, "a b c d e f"), (1, "a b c d e f g"), (2, "a b c d e"), (3, None)], "n bigint, text string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 3)], "u bigint, v bigint")
    for partners in (1, 1000):
        got = sorted(tuple(r) for r in similar.verified(pairs, docs, "n", 5, 0.5, partners).collect())
        assert got == [(0, 1), (0, 2)]


def test_odd_rows(spark, odd_docs, no_docs):
    out = similar.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    assert got == [1, 3, 6, 7, 8, 9]
    assert similar.keep_one(no_docs).collect() == []


def test_no_pair_is_lost(spark):
    """Pairs just above the similarity, of which the fingerprints' keys miss about one in eight, and common passages."""
    rng, rows = random.Random(3), []
    common = [f"c{i}" for i in range(30)]
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 300))]
        other, k = list(words), 0
        while True:  # changes words until one more would be too many
            other[rng.randrange(len(other))] = f"x{k}"
            a, b = grams(" ".join(words)), grams(" ".join(other))
            if len(a & b) < 0.8 * len(a | b):
                break
            last, k = list(other), k + 1
        rows += [(2 * i, " ".join(words + common)), (2 * i + 1, " ".join(last + common))]
    docs = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], DOCS)
    want = {d for d, r in brute_roots(rows).items() if d == r}
    assert 150 <= len(want) < 155
    for limit in (2000, 40):
        assert {r.doc_id for r in similar.keep_one(docs, limit=limit).select("doc_id").collect()} == want


def test_prefixes_meet_every_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        every = rng.permutation(2 * n + 2)
        cut = int(rng.integers(0, n + 1))
        x, y = np.sort(every[:n]), np.sort(every[cut : cut + int(rng.integers(1, n + 2))])
        both = np.intersect1d(x, y)
        if len(both) < 0.8 * len(np.union1d(x, y)) - 1e-9:
            continue
        at = np.array([np.searchsorted(x, both[0]), np.searchsorted(y, both[0])])
        sizes = np.array([len(x), len(y)])
        assert all(a <= k - int(np.ceil(0.8 * k - 1e-9)) for a, k in zip(at, sizes))
        assert [(i, o.tolist()) for i, o in similar.crossing_pairs(np.array([0, 1]), sizes, at, 0.8)] == [(0, [1])]


def test_sketches_keep_every_near_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 4000))
        every = rng.integers(-(2**63), 2**63 - 1, 2 * n + 2)
        cut = int(rng.integers(0, n // 5 + 1))
        x, y = every[:n], every[cut : cut + int(rng.integers(n - n // 5, n + 2))]
        apart = len(np.setxor1d(x, y))
        a, b = (np.frombuffer(similar.odd_sketch(h), np.uint64) for h in (x, y))
        assert np.bitwise_count(a ^ b).sum() <= apart
    assert similar._among(np.array([1, 5, 9]), np.array([5, 7])).tolist() == [False, True, False]
    assert similar._among(np.array([1, 5]), np.array([], np.int64)).tolist() == [False, False]


def test_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    """What meets by a passage in the prefixes is told apart by its sketches; what is near goes on."""
    monkeypatch.setattr(similar, "common_hashes", lambda *_: np.array([], np.int64))
    rng, rows = random.Random(4), []
    passage = [f"p{i}" for i in range(80)]
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((2 * i, " ".join(words + passage)))
        if i % 4 == 0:
            words[50], words[150] = "x", "y"
            rows.append((2 * i + 1, " ".join(words + passage)))
    docs = spark.createDataFrame(rows, "n bigint, text string")
    roots = spark.createDataFrame([(n, n) for n, _ in rows], "row bigint, root bigint")
    got = sorted(tuple(r) for r in similar.rest(docs, "n", roots, 5, 0.8).collect())
    assert got == [(2 * i, 2 * i + 1) for i in range(0, 60, 4)]


def test_folded_sketches_keep_every_near_pair():
    """Sketches grow with the sets; where two have other lengths, the longer is folded and still no bit is over the true difference."""
    rng = np.random.default_rng(5)
    sets, ends = [], []
    for n in (1, 900, 1020, 1030, 2040, 2050, 5000):
        every = rng.integers(-(2**63), 2**63 - 1, 2 * n + 2)
        sets += [(every[:n], every[n // 9 : n // 9 + n]), (every[:n], every[n : 2 * n + 2])]
    for x, y in sets:
        ends.append([similar.odd_sketch(h, similar.sketch_bits(len(h))) for h in (x, y)])
    apart = similar.sketches_apart(*map(list, zip(*ends)))
    for (x, y), d in zip(sets, apart.tolist()):
        assert d <= len(np.setxor1d(x, y))
        if len(x) > 1 and not len(np.intersect1d(x, y)):  # nothing in common: shown to be less similar, however long
            assert d > (len(x) + len(y)) * 0.2 / 1.8
    assert similar.sketches_apart([], []).tolist() == []


def test_long_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    """Of 3000 shingles each, which fill a sketch of 1024 bits."""
    monkeypatch.setattr(similar, "common_hashes", lambda *_: np.array([], np.int64))
    rng, rows = random.Random(6), []
    passage = [f"p{i}" for i in range(200)]
    for i in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        rows.append((2 * i, " ".join(words + passage)))
        if i % 4 == 0:
            words[50], words[1500] = "x", "y"
            rows.append((2 * i + 1, " ".join(words + passage)))
    docs = spark.createDataFrame(rows, "n bigint, text string")
    roots = spark.createDataFrame([(n, n) for n, _ in rows], "row bigint, root bigint")
    got = sorted(tuple(r) for r in similar.rest(docs, "n", roots, 5, 0.8).collect())
    assert got == [(2 * i, 2 * i + 1) for i in range(0, 12, 4)]


def test_passages_are_known_however_many_rows_there_are(spark, monkeypatch):
    """A passage that a fixed part of the rows has is known to be common, though a sample of fixed size holds it once at most."""
    monkeypatch.setattr(similar, "SAMPLE", 20)
    rng, often, passage = random.Random(7), [f"o{i}" for i in range(6)], [f"p{i}" for i in range(12)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(8)] + often * (i % 4 == 0) + passage * (i % 40 == 0))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "n bigint, text string")
    inner = [set(similar._hashes(" ".join(x).encode(), 5).tolist()) for x in (often, passage)]
    found = similar.common_hashes(docs, "n", 5).tolist()
    assert inner[0] | inner[1] <= set(found)
    assert set(found[-2:]) == inner[0]  # the rarest come first
    monkeypatch.setattr(similar, "COMMON", 5)
    assert set(similar.common_hashes(docs, "n", 5).tolist()) == inner[0]  # whole levels, from the top
