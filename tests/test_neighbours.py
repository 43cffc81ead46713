"""Joins over the cell index against brute force: dense spots, equal points, tolerance, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoplane.functions import geodesic
from geoplane.operators import neighbours as nb

RNG = np.random.default_rng(5)


def frame(spark, lat, lon, key, first=0):
    return spark.createDataFrame([(first + i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], f"{key} long, lat double, lon double")


def distances(x, y):
    return np.stack([geodesic.inverse(a, b, y[0], y[1])["s12"] for a, b in zip(*x)])


@pytest.fixture(scope="module")
def spots(spark):
    """200 points all over, 3000 within some kilometres, 600 within a metre and 300 that are one point."""
    lat = np.r_[RNG.uniform(-90, 90, 200), 48 + RNG.normal(size=3000) * 0.01, 10 + RNG.normal(size=600) * 1e-6, np.full(300, -33.0)]
    lon = np.r_[RNG.uniform(-180, 180, 200), 2 + RNG.normal(size=3000) * 0.01, 179.9999999 + RNG.normal(size=600) * 1e-6, np.full(300, 70.0)]
    from_lat = np.r_[RNG.uniform(-90, 90, 60), 48 + RNG.normal(size=15) * 0.02, 10.0, 10.001, -33.0, -33.00001, 90, -90]
    from_lon = np.r_[RNG.uniform(-180, 180, 60), 2 + RNG.normal(size=15) * 0.02, -179.9999999, 180.0, 70.0, 70.0, 0, 0]
    d = distances((from_lat, from_lon), (lat, lon))
    return frame(spark, from_lat, from_lon, "id"), nb.build_index(frame(spark, lat, lon, "other", 1000), "other"), d


def test_cells_are_split(spots):
    _, index, d = spots
    assert index.total == d.shape[1] == index.points.count()
    leaves = index.nodes.select("level", F.explode("children").alias("c")).select("level", "c.*").filter("leaf").collect()
    assert sum(r.n for r in leaves) == index.total and all(r.n <= index.leaf or r.level == nb.LEVELS[-1] for r in leaves)
    assert max(r.n for r in leaves) == 300 or max(r.n for r in leaves) > 64


@pytest.mark.parametrize("k", [1, 400])
def test_nearest(spots, k):
    left, index, d = spots
    got = nb.nearest_join(left, index, "id", "other", k).collect()
    assert len(got) == len(d) * k
    mine = np.full((len(d), k), -1)
    for r in got:
        mine[r.id, r["rank"] - 1] = r.other - 1000
    for i, row in enumerate(d):
        order = np.lexsort((np.arange(len(row)), row))[:k]
        assert np.abs(row[mine[i]] - row[order]).max() < 1e-8 and len(set(mine[i])) == k


@pytest.mark.parametrize("tolerance", [2e6])
def test_tolerance(spots, tolerance):
    left, index, d = spots
    got = nb.nearest_join(left, index, "id", "other", 5, tolerance=tolerance).collect()
    want = np.sort(d, axis=1)[:, :5]
    assert len(got) == want.size
    assert all(r.distance <= want[r.id, r["rank"] - 1] + tolerance and abs(d[r.id, r.other - 1000] - r.distance) < 1e-8 for r in got)


def test_no_task_meets_a_dense_spot_whole(spots):
    """Rows meet few points more than they are near to, in parts of a leaf's size."""
    left, index, d = spots
    rows = nb._placed(left, "id", "_l", index.e)
    cells = rows.withColumn("at", nb._at(index)).join(nb._reached(rows, index, 10.0, lambda p: p), "at").filter(nb._least(F.col("cell")) <= 10)
    met = nb._met(cells.select("_l", *nb.AXES, "cell"), index, lambda found: found)
    n = met.groupBy(F.col("_l").alias("id")).count().collect()
    near = (d <= 10).sum(axis=1)
    assert all(r["count"] <= near[r.id] + 40 * index.leaf for r in n)


def test_radius(spots):
    left, index, d = spots
    for radius in (0.5, 3e6):
        got = {(r.id, r.other - 1000) for r in nb.radius_join(left, index, "id", "other", radius).collect()}
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= radius))))
    assert {r.id for r in nb.within_radius(left, index, "id", "other", 2e5).collect()} == set(np.flatnonzero(d.min(axis=1) <= 2e5).tolist())


def test_limits(spots):
    left, index, d = spots
    got = nb.nearest_join(left, index, "id", "other", 3, most=1e6, least=100.0).collect()
    mine = {(r.id, r["rank"]): r.distance for r in got}
    want = {(i, k + 1): v for i, row in enumerate(d) for k, v in enumerate(np.sort(row[(row > 100) & (row <= 1e6)])[:3])}
    assert mine.keys() == want.keys() and all(math.isclose(mine[k], want[k], abs_tol=1e-8) for k in want)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0), (4, 91.0, 0.0)], "id long, lat double, lon double")
    none = rows.limit(0)
    other = rows.withColumnRenamed("id", "other")
    assert [tuple(r)[:2] for r in nb.nearest_join(rows, other, "id", "other", 9).collect()] == [(1, 1)]
    assert nb.nearest_join(none, other, "id", "other", 2).collect() == nb.nearest_join(rows, other.limit(0), "id", "other", 2).collect() == []
    assert nb.radius_join(rows, other.limit(0), "id", "other", 5.0).collect() == [] == nb.nearest_join(rows, other, "id", "other", 0).collect()
    assert nb.nearest_join(rows, other.limit(0), "id", "other", 2).columns == nb.nearest_join(rows, other, "id", "other", 2).columns


def test_short_distances():
    """Against geodesics, at poles, along meridians, across the date line and between equal points too."""
    rng = np.random.default_rng(7)
    lat, lon, azi = np.degrees(np.arcsin(rng.uniform(-1, 1, 4000))), rng.uniform(-180, 180, 4000), rng.uniform(-180, 180, 4000)
    lat[:500], lat[500:600], lat[600:700] = 90 - rng.uniform(0, 3, 500), -90, 0
    azi[700:800], azi[650:700], lon[800:900] = 180, 90, 180
    for far in (0.0, 1.0, 1e3, 5e5, 1e6):
        p = geodesic.direct(lat, lon, azi, rng.uniform(0, far, 4000))
        want = geodesic.inverse(lat, lon, p["lat2"], p["lon2"], fields=("s12",))["s12"]
        (sb1, cb1), (sb2, cb2) = geodesic.reduced(lat, nb.WGS84), geodesic.reduced(p["lat2"], nb.WGS84)
        got = geodesic.short_distance(sb1, cb1, sb2, cb2, np.radians(geodesic.difference(lon, p["lon2"])), nb.WGS84)
        assert np.abs(got - want).max() < 1e-7
