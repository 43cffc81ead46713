import random
import re
from collections import defaultdict

import duckdb
import pytest

from geoplane.llm import mixing

SF = "/root/testdata/sf0.01"


def brute_targets(sizes):
    """sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        share = left / sum(w[s] for s in free)
        full = [s for s in free if share * w[s] > 3 * sizes[s]]
        if not full:
            return out | {s: share * w[s] for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def check(rows, docs, near):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size, r.source) for r in rows if r.doc_id is not None) == sorted((d, size(t), s) for d, t, s in docs if d is not None)
    total = defaultdict(int)
    for _, t, s in docs:
        total[s] += size(t)
    want, taken = brute_targets(total), defaultdict(int)
    for r in rows:
        assert r.source_size == total[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= near * total[s] + 60, (s, taken[s], want[s])


def test_query(spark):
    docs = duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()
    rows = mixing.op7_mixing(spark, SF).collect()
    check(rows, docs, 0.03)
    again = mixing.op7_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_groups_are_joined_until_one_lands(spark):
    rng = random.Random(3)
    docs = [(i, "w " * rng.choice([1, 5, 5, 40, 200]), rng.choice(["a", "b", "b", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    check(mixing.mix(df, group=20).collect(), docs, 0.005)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(no_docs).collect() == []


def test_flight_keeps_totals_and_draws_fairly():
    x = [float(v) for v in random.Random(1).choices(range(1, 50), k=60)]
    p = [0.3] * 60
    took = [0] * 60
    for seed in range(400):
        q = mixing.flight(p, x, random.Random(seed))
        assert sum(0 < v < 1 for v in q) <= 2
        assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(q, x)) == pytest.approx(sum(a * b for a, b in zip(p, x)))
        took = [t + v for t, v in zip(took, q)]
    assert all(0.2 < t / 400 < 0.4 for t in took)
