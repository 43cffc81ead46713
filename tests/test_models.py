"""Queries of fields, grids and exact sums against SQL; circles, truncation, tiles and sums against plain forms."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoplane.functions import geodesic, harmonics as h, raster as cells
from geoplane.operators import fields, raster, sums
from geoplane.plans import models

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(0)


@pytest.mark.parametrize("name", list(models.ORACLE_SQL))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = models.QUERIES[name](spark, SF), con.sql(models.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows, other = (sorted(map(tuple, x)) for x in (got.select("id", *(c for c in columns if c != "id")).collect(), want.select("id", *(c for c in columns if c != "id")).fetchall()))
    assert len(rows) == len(other) > 0
    for a, b in zip(rows, other):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)


def random_coefficients(n, m):
    c, s = (np.tril(RNG.normal(size=(n + 1, n + 1)))[:, : m + 1] for _ in range(2))
    s[:, 0] = 0
    return h.Coefficients(c, s)


def test_degree_2190():
    """A single coefficient of degree 2190, order 650, whose diagonal term is 1e-330."""
    c = np.zeros((2191, 651))
    c[2190, 650] = 1.0
    k = h.Coefficients(c, np.zeros_like(c))
    u, t = 0.31, math.sqrt(1 - 0.31**2)
    got = h.harmonic_sum(k, 1.0, u, 0.0, t)
    m = 650  # the same by a recursion over degrees with whole numbers, scaled
    log = 0.5 * (math.log(3) + sum(math.log((2 * i + 1) / (2 * i)) for i in range(2, m + 1))) + m * math.log(u)
    before, now, t2 = 0, 10**60, int(t * 10**40)
    for n in range(m + 1, 2191):
        a = math.isqrt(10**80 * (2 * n - 1) * (2 * n + 1) // ((n - m) * (n + m)))
        b = math.isqrt(10**80 * (2 * n + 1) * (n + m - 1) * (n - m - 1) // ((n - m) * (n + m) * (2 * n - 3))) if n > m + 1 else 0
        before, now = now, (a * t2 // 10**40) * now // 10**40 - b * before // 10**40
    want = math.exp(log + math.log(abs(now)) - 60 * math.log(10)) * (1 if now > 0 else -1)
    assert got["v"][0] == pytest.approx(want, rel=1e-9) and got["v"][0] == pytest.approx(2.328, abs=5e-4)
    assert got["gx"][0] * u + got["gz"][0] * t == pytest.approx(-2191 * want, rel=1e-9)


def test_circles_are_point_sums():
    k = random_coefficients(180, 150)
    lat, lon = np.repeat([0.0, 37.5, -89.9999, 90.0, -90.0], 200), RNG.uniform(-180, 180, 1000)
    c, s = np.cos(np.radians(lat)), np.sin(np.radians(lat))
    xyz = 1.1 * c * np.cos(np.radians(lon)), 1.1 * c * np.sin(np.radians(lon)), 1.1 * s
    for schmidt in (False, True):
        on = h.harmonic_sum(k, 1.0, *xyz, schmidt, h.circles_of(lat))
        alone = h.harmonic_sum(k, 1.0, *xyz, schmidt)
        for name in on:
            assert np.abs(on[name] - alone[name]).max() < 1e-12 * np.abs(alone[name]).max()
    # at a pole the gradient is what it is close to it
    pole, near = (h.harmonic_sum(k, 1.0, [v], [0.0], [1.1]) for v in (0.0, 1e-9))
    assert all(np.isclose(pole[n], near[n], rtol=1e-5, atol=1e-5 * abs(pole["v"][0])) for n in pole)


def test_truncation():
    import io

    k = random_coefficients(9, 7)
    for n, m in ((None, None), (5, None), (None, 3), (6, 2), (20, 20)):
        stream = io.BytesIO(k.written() + b"next")
        part = h.Coefficients.read(stream, n, m)
        assert stream.read() == b"next"
        n, m = min(n or 9, 9), min(m if m is not None else 7, 7, n or 9)
        assert part.c.shape == (n + 1, m + 1) and (part.c == k.c[: n + 1, : m + 1]).all() and (part.s == k.s[: n + 1, : m + 1]).all()


def test_models_by_circles(spark):
    """Gravity and magnetic columns after by_circles are those of points one by one."""
    from tests.test_fields import gravity_files

    model = h.GravityModel.read(*gravity_files())
    rows = [(i, float(i % 7 * 10), float(i), float(i % 2 * 100)) for i in range(300)]
    points = spark.createDataFrame(rows, "id int, lat double, lon double, h double")
    got = {r.id: r.g for r in fields.by_circles(points).withColumn("g", fields.disturbance(model, F.col("lat"), F.col("lon"), F.col("h"))).collect()}
    for i, lat, lon, height in rows[::17]:
        want = model.disturbance(lat, lon, height)
        assert all(got[i][c] == pytest.approx(want[c][0], rel=1e-12, abs=1e-9) for c in want)


def plain_height(grid, lat, lon, smooth):
    """Heights by least squares at every point."""
    rows, columns = grid.shape
    out = []
    for a, b in zip(lat, lon):
        y, x = (90 - a) * (rows - 1) / 180, (b % 360) * columns / 360
        iy, ix = min(int(y), rows - 2), int(x)

        def at(r, c):
            if r < 0 or r >= rows:
                r, c = -r if r < 0 else 2 * (rows - 1) - r, c + columns // 2
            return grid[r, c % columns]

        x, y = x - ix, y - iy
        if not smooth:
            out.append((1 - y) * ((1 - x) * at(iy, ix) + x * at(iy, ix + 1)) + y * ((1 - x) * at(iy + 1, ix) + x * at(iy + 1, ix + 1)))
            continue
        pole = 1 if iy == rows - 2 else 0
        up = (lambda r: 1 - r) if pole else (lambda r: r)
        terms = [(i, j) for i in range(4) for j in range(4 - i) if not (i and not j and iy in (0, rows - 2))]
        around = [(r, c) for r in range(-1, 3) for c in range(-1, 3) if r in (0, 1) or c in (0, 1)]
        w = np.array([math.sqrt(2) if r in (0, 1) and c in (0, 1) else 1 for r, c in around])
        fit = np.linalg.lstsq(np.array([[float(c) ** i * float(up(r)) ** j for i, j in terms] for r, c in around]) * w[:, None], np.array([at(iy + r, ix + c) for r, c in around]) * w, rcond=None)[0]
        out.append(sum(f * x**i * up(y) ** j for f, (i, j) in zip(fit, terms)))
    return np.array(out)


def grey_map(tmp_path, pixels):
    path = tmp_path / "grid.pgm"
    path.write_bytes(b"P5\n# Geoid\n# Offset -108\n# Scale 0.003\n%d %d\n65535\n" % pixels.shape[::-1] + pixels.astype(">u2").tobytes())
    return str(path)


@pytest.mark.parametrize("side", [4, 8, 64])
def test_tiles_are_the_grid(spark, tmp_path, side):
    pixels = RNG.integers(0, 65536, (19, 36))
    grid = raster.read_raster(spark, grey_map(tmp_path, pixels))
    lat, lon = np.r_[RNG.uniform(-90, 90, 300), 90, 90, -90, -90, 85, -85, 0, 10], np.r_[RNG.uniform(-400, 400, 300), 0, 77, 0, 181, 359.999, -1e-13, 180, -180]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "id int, lat double, lon double")
    for smooth in (True, False):
        got = np.array([r.height for r in raster.raster_heights(points, grid, smooth, side=side).orderBy("id").collect()])
        assert np.abs(got - plain_height(-108 + 0.003 * pixels, lat, lon, smooth)).max() < 1e-9


def test_poles_and_odd_points(spark, tmp_path):
    grid = raster.read_raster(spark, grey_map(tmp_path, RNG.integers(0, 65536, (19, 36))))
    rows = [(i, 90.0, float(i * 2)) for i in range(5)] + [(i, -90.0, float(i * 2 - 10)) for i in range(5, 10)] + [(10, None, 1.0), (11, 91.0, 0.0), (12, float("nan"), 0.0), (13, 0.0, float("inf")), (14, 0.0, None)]
    points = spark.createDataFrame(rows, "id int, lat double, lon double").withColumn("cells", F.lit("x")).withColumn("ty", F.lit(1)).withColumn("h", F.lit(10.0))
    got = {r.id: r for r in raster.raster_heights(points, grid).collect()}
    assert np.ptp([got[i].height for i in range(5)]) < 1e-9 and np.ptp([got[i].height for i in range(5, 10)]) < 1e-9
    assert all(got[i].height is None for i in range(10, 15)) and got[0].cells == "x"
    up = raster.above_ellipsoid(points, grid, "h", "up").filter("id = 0").first().up
    assert up == pytest.approx(10 + got[0].height) and raster.above_geoid(points, grid, "h", "down").filter("id = 0").first().down == pytest.approx(10 - got[0].height)
    with pytest.raises(ValueError):
        raster.read_raster(spark, grey_map(tmp_path, np.zeros((18, 36), int)))


def test_cubics_fit_cubics():
    """A cubic comes back; at a pole one whose edge is level."""
    x, y = RNG.uniform(0, 1, (2, 50))
    for kind, f in ((cells.INNER, lambda x, y: 1 + 2 * x - y + x * y * y - x**3), (cells.NORTH, lambda x, y: 3 + y * x - y**3 + x * x * y), (cells.SOUTH, lambda x, y: 3 + (1 - y) * x - (1 - y) ** 3)):
        values = np.array([np.full(50, f(c, r)) for r, c in cells.CELLS])
        assert np.allclose(cells.between(values, x, y, np.full(50, kind)), f(x, y), atol=1e-12)


def test_sums_are_exact(spark):
    rng = np.random.default_rng(3)
    own = {
        "wide": rng.normal(size=4000) * 10.0 ** rng.integers(-300, 300, 4000), "cancel": np.r_[1e16, 1.0, -1e16, 1e-300, -1.0], "tiny": np.r_[5e-324, 5e-324, -1e-310, 2.0**-900],
        "zero": np.r_[0.0, -0.0], "far": np.r_[1.7e308, 1e308, -1.7e308], "powers": 2.0 ** np.arange(-1070, 1020, 7), "inf": np.r_[1.0, np.inf], "nan": np.r_[np.inf, -np.inf], "over": np.r_[1.7e308, 1.7e308],
    }
    rows = [(k, float(v)) for k, values in own.items() for v in values] + [("null", None), (None, 2.5)]
    got = {r.k: (r["sum"], r["rest"]) for r in sums.accurate_sums(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
    assert "null" not in got and got[None] == (2.5, 0.0)
    assert got["inf"][0] == math.inf and math.isnan(got["nan"][0]) and got["over"][0] == math.inf
    for k in ("wide", "cancel", "tiny", "zero", "far", "powers"):
        exact = sum(map(Fraction, own[k].tolist()))
        assert got[k] == (float(exact), float(exact - Fraction(float(exact)))), k


def test_a_million_values_of_one_key(spark):
    v = (F.rand(1) - 0.5) * F.pow(F.lit(10.0), F.floor(F.rand(2) * 40) - 20)
    rows = spark.range(0, 1_000_000, 1, 40).select(F.lit(1).alias("k"), v.alias("v")).cache()
    want = math.fsum(r.v for r in rows.toLocalIterator())
    assert sums.accurate_sums(rows, "k", "v").first()["sum"] == want
    rows.unpersist()


def test_exact_sums_as_registered(spark):
    got = {r.ten: (r["sum"], r["rest"]) for r in models.exact_sums(spark, SF).collect()}
    exact = {}
    for doc_id, n in duckdb.sql(f"select doc_id, n_chars from '{SF}/documents.parquet'").fetchall():
        ten = -1 if doc_id % 3 == 0 else doc_id // 10
        exact[ten] = exact.get(ten, 0) + Fraction(float(n) * 1e15 if doc_id % 2 == 0 else -float(n) / 3)
    assert got == {k: (float(v), float(v - Fraction(float(v)))) for k, v in exact.items()}


def test_tolerant_pairs_as_registered(spark):
    rows = models.tolerant_pairs(spark, SF).collect()
    ids = [r[0] for r in duckdb.sql(f"select doc_id from '{SF}/documents.parquet'").fetchall()]
    k = np.array(ids)
    lat, lon = (k * 7919) % 17001 / 100.0 - 85, (k * 104729) % 36000 / 100.0 - 180
    d = {i: geodesic.inverse(a, b, lat, lon)["s12"] for i, a, b in zip(ids, lat, lon)}
    assert len(rows) == 3 * len(ids)
    for r in rows:
        others = np.sort(d[r.id][d[r.id] > 0])
        assert r.distance <= others[r["rank"] - 1] + 5000 and abs(d[r.id][ids.index(r.other)] - r.distance) < 1e-3
