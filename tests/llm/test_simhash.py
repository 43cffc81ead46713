import random
from collections import defaultdict

import duckdb
import xxhash

from geoplane.llm import simhash
from geoplane.llm.components import components

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: (doc_id, fp) rows -> component of each fp."""
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = list({f for _, f in fps})
    root = {f: f for f in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return {f: least.get(find(f)) for f in distinct}


def result(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def expected(rows):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    of = brute_components(fps)
    return sorted(((d, f"{f:016x}", of[f]) for d, f in fps), key=str)


def test_query_is_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert result(simhash.op1_simhash(spark, SF)) == expected(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert result(simhash.near_duplicates(odd_docs)) == expected(rows)
    assert simhash.near_duplicates(no_docs).collect() == []


def test_lists_split_into_parts_lose_no_link(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for c in centres for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp bigint"), limit=7)
    roots = {r.node: r.root for r in components(links).collect()}
    groups, want = defaultdict(set), brute_components([(f, f) for f in fps])
    for f, s in zip(fps, signed):
        groups[roots.get(s, s)].add(f)
    by = defaultdict(set)
    for f, c in want.items():
        by[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by.values()))


def test_components_of_long_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
