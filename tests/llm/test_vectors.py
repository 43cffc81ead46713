import math

import duckdb
import numpy as np
import pytest

from geoplane.llm import vectors

SF = "/root/testdata/sf0.1"


def brute(rows):
    ok = [(v, np.array(e, np.float64)) for v, e in rows if v is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    x = np.stack([e / np.linalg.norm(e) for _, e in ok])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids, comp = np.array([v for v, _ in ok]), np.array([v for v, _ in ok])
    while True:
        least = np.where(near, comp[None, :], comp[:, None]).min(axis=1)
        least = np.minimum(comp, least)
        if (least == comp).all():
            return sorted(zip(ids.tolist(), near.sum(axis=1).tolist(), comp.tolist()))
        comp = least


def rows(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def test_recall_and_precision(spark):
    rng, data = np.random.default_rng(5), [e for (e,) in duckdb.sql(f"select embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()]
    for e in data[:300]:
        e = np.array(e, np.float64)
        data.append((e + np.linalg.norm(e) / np.sqrt(len(e)) * rng.choice([0.1, 0.25, 0.3, 0.33, 0.36]) * rng.normal(size=len(e))).tolist())
    data = [(i * 3, e) for i, e in enumerate(data)]
    want = brute(data)
    got = sorted(rows(vectors.near_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"))))
    links = {v: n for v, n, _ in want}
    assert all(n <= links[v] for v, n, _ in got)
    assert sum(n for _, n, _ in got) >= 0.98 * sum(links.values()) > 200
    assert len(vectors.op2_embeddings(spark, SF).collect()) == 2000


def test_hot_buckets_are_split_and_counted_once(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    data = [(i, (centre + 0.05 * rng.normal(size=16)).tolist()) for i in range(150)] + [(200 + i, rng.normal(size=16).tolist()) for i in range(50)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert rows(vectors.near_vectors(df, limit=20)) == sorted(brute(data), key=str)


@pytest.mark.parametrize("parts", sorted(vectors.EFFORT))
@pytest.mark.parametrize("size", [16, 64, 128, 768])
def test_recall_at_every_number_of_hashes(parts, size):
    """Pairs of random direction, little over the least cosine, that share a bucket."""
    rng = np.random.default_rng(parts * 1000 + size)
    x, r = (vectors.unit(rng.standard_normal((300, size))) for _ in range(2))
    r = vectors.unit(r - (r * x).sum(axis=1, keepdims=True) * x)
    c = 0.951
    tables, probes = vectors.EFFORT[parts]
    a, b = (vectors.bucket_codes(v, parts, tables, probes).reshape(300, tables, probes) for v in (x, c * x + np.sqrt(1 - c * c) * r))
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.95


def test_number_of_hashes():
    assert [vectors.hashes_joined(n, 64) for n in (0, 50_000, 10**9, 10**10, 10**15)] == [1, 2, 4, 5, 6]


def test_forced_hashes_give_the_same(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 32))
    data = [(i, (base[i % 60] + 0.1 * rng.normal(size=32)).tolist()) for i in range(180)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    for parts in (1, 4, 6):
        assert rows(vectors.near_vectors(df, parts=parts)) == sorted(brute(data), key=str)


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]
    data = [(1, a), (2, b), (2, b), (3, [2.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [1.0, 0.0]), (None, a), (10, [float("inf"), 0.0, 0.0]), (11, [0.0, 1e300, 1e300]), (12, [0.0, 1e-300, 1e-300])]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id bigint, embedding array<double>, rep int")
    got = rows(vectors.near_vectors(df))
    want = [(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 3, 1), *((i, 0, i) for i in (4, 5, 6, 7, 8, 9, 10)), (None, 0, None), (11, 1, 11), (12, 1, 11)]
    assert got == sorted(want, key=str)
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = vectors.hadamard(x)
    assert np.allclose((x * x).sum(axis=1), (y * y).sum(axis=1)) and np.allclose(vectors.hadamard(y), x)
