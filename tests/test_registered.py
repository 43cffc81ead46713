"""Values of registered queries that SQL can't express, against plain forms on the whole of their tables."""

import duckdb
import numpy as np

from geoplane.functions import geodesic
from geoplane.functions.ellipsoid import WGS84
from geoplane.plans import queries

SF = "/root/testdata/sf0.001"


def places(keys):
    k = np.asarray(keys, dtype=np.int64)
    return (k * 7919) % 17001 / 100.0 - 85.0, (k * 104729) % 36000 / 100.0 - 180.0


def keys(table, key):
    return [r[0] for r in duckdb.sql(f"select {key} from '{SF}/{table}.parquet' order by 1").fetchall()]


def unit(lat, lon):
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


def test_track_length(spark):
    rows = duckdb.sql(f"select user_id, event_id from '{SF}/events.parquet' order by user_id, ts, event_id").fetchall()
    users, events = (np.array(c) for c in zip(*rows))
    lat, lon = places(events)
    step = np.r_[0.0, geodesic.inverse(lat[:-1], lon[:-1], lat[1:], lon[1:])["s12"]]
    first = np.r_[True, users[1:] != users[:-1]]
    step[first] = 0.0
    total = np.cumsum(step)
    want = total - np.maximum.accumulate(np.where(first, total, 0))
    got = {(r.user_id, r.event_id): r.so_far for r in queries.track_length(spark, SF).collect()}
    assert len(got) == len(rows)
    assert max(abs(got[u, e] - w) for (u, e), w in zip(rows, want.tolist())) < 2e-3


def test_geodesic_waypoints(spark):
    rows = queries.geodesic_waypoints(spark, SF).collect()
    ids = keys("supplier", "s_suppkey")
    assert sorted((r.id, r.k) for r in rows) == [(i, k) for i in ids for k in range(5)]
    lat, lon = places([r.id for r in rows])
    k, y, x = (np.array([r[c] for r in rows]) for c in ("k", "lat", "lon"))
    whole = geodesic.inverse(lat, lon, 0.0, 10.0)["s12"]
    assert np.abs(geodesic.inverse(lat, lon, y, x)["s12"] - whole * k / 4).max() < 0.5  # coordinates have six decimals
    assert np.abs(geodesic.inverse(y, x, 0.0, 10.0)["s12"] - whole * (4 - k) / 4).max() < 0.5


def test_all_intersections(spark):
    most, half = 4.2e7, np.pi * WGS84.a
    found: dict = {}
    for r in queries.all_intersections(spark, SF).collect():
        found.setdefault(r.id, []).append((r["rank"], r.x, r.y))
    ids = keys("supplier", "s_suppkey")
    lat, lon = places(ids)
    for i, a, b in zip(ids, lat, lon):
        own = sorted(found[i])
        x, y = np.array([p[1] for p in own]), np.array([p[2] for p in own])
        assert (np.diff(np.abs(x) + np.abs(y)) > -0.02).all() and [p[0] for p in own] == list(range(1, len(own) + 1))
        p, q = geodesic.direct(a, b, b / 2 + 7, x), geodesic.direct(10.0, 20.0, 33.0, y)
        assert geodesic.inverse(p["lat2"], p["lon2"], q["lat2"], q["lon2"])["s12"].max() < 0.05
        # as on a sphere, half a turn of both lines, or a whole one of either, leads to the next
        count = lambda far: sum(abs(x[0] + m * half) + abs(y[0] + n * half) <= far for m in range(-5, 6) for n in range(-5, 6) if (m + n) % 2 == 0)  # noqa: E731, B023
        assert count(most - 4e5) <= len(own) <= count(most + 4e5), i


def test_segment_crossings(spark):
    got = {r.id: (r.inside, r.x) for r in queries.segment_crossings(spark, SF).collect()}
    ids = keys("customer", "c_custkey")
    assert sorted(got) == ids
    lat, lon = places(ids)
    inside, x = np.array([got[i][0] for i in ids]) == 1, np.array([got[i][1] if got[i][0] else np.nan for i in ids])
    line = geodesic.inverse(lat, lon, 0.0, 0.0, fields=("s12", "azi1"))
    at = geodesic.direct(lat[inside], lon[inside], line["azi1"][inside], x[inside])
    ends = [(-60.0, 30.0), (60.0, 30.5)]
    apart = sum(geodesic.inverse(at["lat2"], at["lon2"], *e)["s12"] for e in ends) - geodesic.inverse(*ends[0], *ends[1])["s12"]
    assert inside.any() and np.abs(apart).max() < 0.05 and (x[inside] <= line["s12"][inside] + 0.01).all()
    # on a sphere: each segment's ends lie on both sides of the other, and where they meet is not opposite
    a, b, c, d = unit(lat, lon), unit(0.0, 0.0), unit(*ends[0]), unit(*ends[1])
    n, m = np.cross(a, b), np.cross(c, d)
    n, m = n / np.linalg.norm(n, axis=1)[:, None], m / np.linalg.norm(m)
    sides = np.stack([n @ c, n @ d, a @ m, np.full(len(a), b @ m)])
    meet = np.cross(n, m)
    meet *= np.sign((meet * (a + b)).sum(axis=1))[:, None]
    crosses = (sides[0] * sides[1] < 0) & (sides[2] * sides[3] < 0) & (meet @ (c + d) > 0)
    clear = np.abs(sides).min(axis=0) > 0.02
    assert (crosses == inside)[clear].all() and clear.mean() > 0.9


def test_radius_pairs(spark, monkeypatch):
    """Each hundredth customer is a query, all suppliers are searched, and no pair is lost."""
    monkeypatch.setitem(globals(), "SF", "/root/testdata/sf0.01")
    got = {(r.id, r.s_id): r.distance for r in queries.radius_pairs(spark, SF).collect()}
    ids, others = [k for k in keys("customer", "c_custkey") if k % 100 == 0], keys("supplier", "s_suppkey")
    d = np.stack([geodesic.inverse(a, b, *places(others))["s12"] for a, b in zip(*places(ids))])
    want = {(ids[i], others[j]): d[i, j] for i, j in zip(*np.nonzero(d <= 500_000.0))}
    assert len(want) == 4 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-3 for k, v in want.items())


def test_radius_pairs_of_all_customers(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.id, r.s_id): r.distance for r in queries.radius_pairs(spark, sf).collect()}
    ids, others = ([r[0] for r in duckdb.sql(f"select {k} from '{sf}/{t}.parquet' order by 1").fetchall()] for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey")))
    d = np.stack([geodesic.inverse(a, b, *places(others))["s12"] for a, b in zip(*places(ids))])
    want = {(ids[i], others[j]): d[i, j] for i, j in zip(*np.nonzero(d <= 500_000.0))}
    assert len(want) > 300 and any(i % 100 for i, _ in want)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-3 for k, v in want.items())
