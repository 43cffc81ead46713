"""Geodesics and the conformal projection of triaxial ellipsoids: closure, invariants, ellipsoids of revolution, a published row."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoplane.functions import geodesic, triaxial_conformal as conformal, triaxial_lines as lines
from geoplane.functions.ellipsoid import WGS84
from geoplane.functions.triaxial import Triaxial
from geoplane.operators import shapes
from geoplane.plans import models

EARTH, ROUND = Triaxial(), Triaxial(WGS84.a, WGS84.a, WGS84.b)
SF = "/root/testdata/sf0.001"


def points(n, seed=0, antipodal=0):
    rng = np.random.default_rng(seed)
    b1, o1, b2, o2 = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    b2[:antipodal] = np.clip(-b1[:antipodal] + rng.normal(0, 0.3, antipodal), -90, 90)
    o2[:antipodal] = o1[:antipodal] + 180 + rng.normal(0, 0.3, antipodal)
    return b1, o1, b2, o2


def space(t, bet, omg):
    return np.stack(list(t.ellipsoidal(bet, omg).values()))


def constant(t, bet, omg, azi):
    (k2, kp2), (b, o, z) = t._k, np.radians([bet, omg, azi])
    return k2 * np.cos(b) ** 2 * np.sin(z) ** 2 - kp2 * np.sin(o) ** 2 * np.cos(z) ** 2


@pytest.mark.parametrize("t, n", [(EARTH, 200), (Triaxial(1.1, 1.0, 0.9), 100), (Triaxial(3.0, 2.0, 1.0), 25), (ROUND, 100)])
def test_lines_close(t, n):
    b1, o1, b2, o2 = points(n, antipodal=n // 5)
    g = lines.inverse(t, b1, o1, b2, o2)
    end = lines.direct(t, b1, o1, g["azi1"], g["s12"])
    assert np.abs(space(t, end["bet2"], end["omg2"]) - space(t, b2, o2)).max() < 3e-12 * t.a
    assert np.allclose(constant(t, b1, o1, g["azi1"]), constant(t, b2, o2, g["azi2"]), atol=1e-10)
    back = lines.inverse(t, b2, o2, b1, o1)
    assert np.abs(back["s12"] - g["s12"]).max() < 1e-12 * t.a
    assert (g["m12"] > -1e-6 * t.a).all() and np.allclose(g["m12"], back["m12"], atol=1e-6 * t.a)
    chord = np.sqrt(((space(t, b1, o1) - space(t, b2, o2)) ** 2).sum(axis=0))
    assert (g["s12"] > chord * (1 - 1e-12)).all()


def test_no_line_of_a_fan_is_shorter():
    """Near the antipodes: of all azimuths, followed in small steps, none comes by earlier."""
    b1, o1, b2, o2 = points(12, seed=3, antipodal=12)
    g = lines.inverse(EARTH, b1, o1, b2, o2)
    azi = np.arange(0, 360, 0.5)
    for i in range(12):
        s = g["s12"][i] - 2000.0
        end = lines.direct(EARTH, b1[i], o1[i], azi, s)
        far = np.sqrt(((space(EARTH, end["bet2"], end["omg2"]) - space(EARTH, b2[i], o2[i])) ** 2).sum(axis=0))
        assert far.min() > 1900.0


def test_with_two_equal_axes_they_are_geodesics():
    b1, o1, b2, o2 = points(200, seed=1, antipodal=40)
    lat = lambda b: np.degrees(np.arctan(WGS84.a / WGS84.b * np.tan(np.radians(b))))
    want = geodesic.inverse(lat(b1), o1, lat(b2), np.remainder(o2 + 180, 360) - 180)["s12"]
    assert np.abs(lines.inverse(ROUND, b1, o1, b2, o2)["s12"] - want).max() < 1e-6


def test_scales_and_reduced_length():
    y, d = lines.direct(EARTH, 20.0, 30.0, 50.0, 8e6), 1e-4
    beside = space(EARTH, *list(lines.direct(EARTH, 20.0, 30.0, 50.0 + d, 8e6).values())[:2]) - space(EARTH, y["bet2"], y["omg2"])
    assert np.linalg.norm(beside) / np.radians(d) == pytest.approx(y["m12"][0], rel=1e-5)
    back = lines.direct(EARTH, y["bet2"], y["omg2"], y["azi2"] + 180, 8e6)
    assert (back["bet2"][0], back["omg2"][0]) == pytest.approx((20, 30), abs=1e-10)
    assert (back["m12"][0], back["scale12"][0]) == pytest.approx((y["m12"][0], y["scale21"][0]), rel=1e-9)


def test_special_points():
    g = lines.inverse(EARTH, [10, np.nan, 91, 90, 0, 0], [20, 0, 0, 0, 0, 0], [10, 5, 5, -90, 0, 0], [20, 5, 5, 180, 90, 180])
    assert g["s12"][0] == g["azi1"][0] == 0 and np.isnan(g["s12"][1:3]).all()
    x = np.linspace(0, np.pi / 2, 20001)
    half = 2 * np.trapezoid(np.sqrt((EARTH.a * np.sin(x)) ** 2 + (EARTH.c * np.cos(x)) ** 2), x)
    assert g["s12"][3] == pytest.approx(half, abs=1e-2)  # all lines between opposite umbilical points are as long
    quarter = np.trapezoid(np.sqrt((EARTH.a * np.sin(x)) ** 2 + (EARTH.b * np.cos(x)) ** 2), x)
    assert g["s12"][4] == pytest.approx(quarter, abs=1e-2) and g["azi1"][4] == pytest.approx(90)
    other = 2 * np.trapezoid(np.sqrt((EARTH.b * np.sin(x)) ** 2 + (EARTH.c * np.cos(x)) ** 2), x)
    assert g["s12"][5] <= half + 1e-2 and g["s12"][5] >= other - 1e5


def test_published_projection():
    f = conformal.forward(EARTH, 33.3, 44.4)
    assert (f["x"][0], f["y"][0]) == pytest.approx((-5077732.396, 3922571.859), abs=6e-4)
    assert f["k"][0] == pytest.approx(1.1970343759, abs=6e-11)
    r = conformal.reverse(EARTH, -5077732.396, 3922571.859)
    assert (r["bet"][0], r["omg"][0]) == pytest.approx((33.3, 44.4), abs=5e-9)


@pytest.mark.parametrize("t", [EARTH, Triaxial(3.0, 2.0, 1.0), ROUND])
def test_projection_is_conformal(t):
    b, o, _, _ = points(300, seed=2)
    f = conformal.forward(t, b, o + 720)
    r = conformal.reverse(t, f["x"], f["y"])
    assert np.allclose(r["bet"], b, atol=1e-9) and np.allclose(r["omg"], o + 720, atol=1e-9)
    d, b = 1e-4, b * 0.8
    for db, do in ((d, 0), (0, d)):
        p, q = conformal.forward(t, b + db, o + do), conformal.forward(t, b - db, o - do)
        k = np.hypot(p["x"] - q["x"], p["y"] - q["y"]) / np.sqrt(((space(t, b + db, o + do) - space(t, b - db, o - do)) ** 2).sum(axis=0))
        assert np.allclose(k, conformal.forward(t, b, o)["k"], rtol=1e-6)
    assert np.isnan(conformal.forward(t, np.nan, 0)["x"][0]) and np.isnan(conformal.forward(t, 91, 0)["y"][0])


def test_spheres_and_other_ellipsoids():
    one, two = EARTH, Triaxial(3.0, 2.0, 1.0)
    b, o, _, _ = points(200, seed=4)
    s = conformal.to_sphere(one, b, o)
    assert np.allclose(np.sqrt(s["x"] ** 2 + s["y"] ** 2 + s["z"] ** 2), conformal.sphere(one)[0], rtol=1e-13)
    g = conformal.from_sphere(one, s["x"], s["y"], s["z"])
    assert np.abs(space(one, g["bet"], g["omg"]) - space(one, b, o)).max() < 1e-11 * one.a
    there, d, b = conformal.to_other(one, two, b * 0.8, o), 1e-4, b * 0.8
    for db, do in ((d, 0), (0, d)):
        p, q = (conformal.to_other(one, two, b + i * db, o + i * do) for i in (1, -1))
        k = np.sqrt(((space(two, p["bet"], p["omg"]) - space(two, q["bet"], q["omg"])) ** 2).sum(axis=0))
        k /= np.sqrt(((space(one, b + db, o + do) - space(one, b - db, o - do)) ** 2).sum(axis=0))
        assert np.allclose(k, there["k"], rtol=1e-6)
    with pytest.raises(ValueError):
        conformal.sphere(ROUND)


def test_registered_lines_end_where_they_should(spark):
    """Each line of the query, followed by plain Runge-Kutta steps in space."""
    rows = models.triaxial_inverse(spark, SF).collect()
    assert sorted(r.id for r in rows) == [r[0] for r in duckdb.sql(f"select doc_id from '{SF}/documents.parquet' order by 1").fetchall()]
    k = np.array([r.id for r in rows])
    s, azi = np.array([r.s12 for r in rows]), np.radians([r.azi1 for r in rows])
    b1, o1, b2, o2 = (k * 7919) % 17001 / 100 - 85, (k * 104729) % 36000 / 100 - 180, (k * 7907) % 17001 / 100 - 85, (k * 104723) % 36000 / 100 - 180
    r, east, north = lines.frame(EARTH, b1, o1)
    w, v = 1 / EARTH.axes2[:, None], east * np.sin(azi) + north * np.cos(azi)
    bend = lambda r, v: -(w * v * v).sum(axis=0) / (w * w * r * r).sum(axis=0) * w * r
    h = s / 400
    for _ in range(400):
        a1 = bend(r, v)
        a2 = bend(r + h / 2 * v, v + h / 2 * a1)
        a3 = bend(r + h / 2 * v + h * h / 4 * a1, v + h / 2 * a2)
        a4 = bend(r + h * v + h * h / 2 * a2, v + h * a3)
        r, v = r + h * v + h * h / 6 * (a1 + a2 + a3), v + h / 6 * (a1 + 2 * a2 + 2 * a3 + a4)
    assert np.sqrt(((r - space(EARTH, b2, o2)) ** 2).sum(axis=0)).max() < 1.0  # azimuths have six decimals


def test_columns(spark):
    df = spark.createDataFrame([(10.0, 20.0, -30.0, 100.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    got = df.select(
        shapes.triaxial_inverse(EARTH, F.col("a"), F.col("b"), F.col("c"), F.col("d"), "s12 m12").alias("g"),
        shapes.triaxial_direct(EARTH, F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("h"),
        shapes.conformal_other(EARTH, Triaxial(3.0, 2.0, 1.0), F.col("a"), F.col("b")).alias("o"),
    ).collect()
    assert got[0].g.s12 == pytest.approx(lines.inverse(EARTH, 10, 20, -30, 100)["s12"][0])
    assert got[0].h.bet2 == pytest.approx(10 + 100 / 111e3, abs=1e-3) and np.isfinite(got[0].o.k)
    assert (got[1].g.s12, got[1].h.bet2, got[1].o.bet) == (None, None, None)
