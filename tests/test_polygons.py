"""Published values of polygons, and edges of other kinds."""

import math

import numpy as np
import pytest

from geoplane.functions import geodesic, rhumb
from geoplane.functions.ellipsoid import WGS84
from geoplane.operators import polygons

# Area of the triangle, of the ellipsoid, and of one circuit at latitude 45.
TRIANGLE, WHOLE, CIRCUIT = 18454562325.45119, 510065621724088.5093, 39433884866571.4277
MODES = [(False, True, lambda a: a), (False, False, lambda a: a), (True, True, lambda a: -a), (True, False, lambda a: WHOLE - a)]
POINTS = "ring string, seq int, lat double, lon double"


def rings(spark, **points):
    return spark.createDataFrame([(k, i, float(a), float(b)) for k, v in points.items() for i, (a, b) in enumerate(v)], POINTS)


def test_whole_ellipsoid():
    assert WGS84.area == pytest.approx(WHOLE, abs=0.5)


@pytest.mark.parametrize("reverse, sign, want", MODES)
def test_triangle_and_circuits(spark, reverse, sign, want):
    circle = [(45, 60), (45, 180), (45, -60)]
    df = rings(spark, triangle=[(2, 1), (1, 2), (3, 3)], three=circle * 3, four=circle * 4)
    got = {r.ring: r.area for r in polygons.polygon_areas(df, "ring", ["seq"], reverse=reverse, sign=sign).collect()}
    assert got["triangle"] == pytest.approx(want(TRIANGLE), abs=0.5)
    assert got["three"] == pytest.approx(want(3 * CIRCUIT), abs=0.5) and got["four"] == pytest.approx(want(4 * CIRCUIT), abs=0.5)
    part = rings(spark, triangle=[(2, 1), (1, 2)], three=(circle * 3)[:-1])
    more = spark.createDataFrame([("triangle", 3.0, 3.0), ("three", 45.0, -60.0), ("none", 1.0, 1.0)], "ring string, lat double, lon double")
    got = {r.ring: (r.n, r.perimeter, r.area) for r in polygons.candidate_areas(part, "ring", ["seq"], more, reverse=reverse, sign=sign).collect()}
    assert got["triangle"][2] == pytest.approx(want(TRIANGLE), abs=0.5) and got["three"][2] == pytest.approx(want(3 * CIRCUIT), abs=0.5)
    assert got["none"] == (1, 0.0, 0.0)


def test_few_points_and_lines(spark):
    df = rings(spark, one=[(1, 1)], two=[(1, 1), (2, 2)])
    got = {r.ring: r for r in polygons.polygon_areas(df, "ring", ["seq"]).collect()}
    assert got["one"].area == got["one"].perimeter == 0 and got["two"].area == pytest.approx(0, abs=1e-3)
    line = {r.ring: r.perimeter for r in polygons.polygon_areas(df, "ring", ["seq"], polyline=True).collect()}
    assert line == {"one": 0, "two": pytest.approx(156876.149, abs=0.5e-3)} and got["two"].perimeter == pytest.approx(2 * line["two"])


def test_edges_by_azimuth(spark):
    starts = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 20.0)], "ring string, lat double, lon double")
    edges = spark.createDataFrame([("a", 1, 90.0, 1000.0), ("a", 2, 0.0, 1000.0), ("a", 3, -90.0, 1000.0)], "ring string, seq int, azi double, s double")
    points = polygons.ring_points(starts, edges, "ring", "seq")
    got = {r.ring: (r.n, r.area) for r in polygons.polygon_areas(points, "ring", ["seq"]).collect()}
    assert got["a"] == (4, pytest.approx(1e6, abs=0.01)) and got["b"] == (1, 0.0)


def test_rhumb_and_authalic(spark):
    cell = [(40, 0), (40, 10), (50, 10), (50, 0)]
    df = rings(spark, cell=cell, small=[(40, 0), (40, 0.001), (40.001, 0.001), (40.001, 0)])
    q = lambda lat: float(rhumb.sin_authalic(lat, WGS84))
    got = {(k, r.ring): r.area for k in polygons.EDGES for r in polygons.polygon_areas(df, "ring", ["seq"], edges=k).collect()}
    assert got["rhumb", "cell"] == pytest.approx(WGS84.authalic2 * math.radians(10) * (q(50) - q(40)), rel=1e-12)
    for k in polygons.EDGES:
        assert got[k, "small"] == pytest.approx(got["geodesic", "small"], rel=1e-4)
    assert abs(got["authalic", "cell"] / got["geodesic", "cell"] - 1) < 1e-3


def test_rhumb_lines():
    r = rhumb.rhumb_inverse(40 + 38 / 60 + 23 / 3600, -(73 + 46 / 60 + 44 / 3600), 1 + 21 / 60 + 33 / 3600, 103 + 59 / 60 + 22 / 3600)
    assert r["s12"][0] == pytest.approx(18523563, abs=1) and r["azi12"][0] == pytest.approx(103 + 34 / 60 + 58.2 / 3600, abs=2e-5)
    assert r["area12"][0] == pytest.approx(45921660958919, abs=1)
    near = rhumb.rhumb_inverse(30.0, 0.0, 30.000000001, 50.0)
    same = rhumb.rhumb_inverse(30.0, 0.0, 30.0, 50.0)
    assert near["s12"][0] == pytest.approx(same["s12"][0], abs=1e-3) and same["azi12"][0] == 90
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.uniform(-89, 89, (4, 2000))
    g = rhumb.rhumb_inverse(*a)
    d = rhumb.rhumb_direct(a[0], a[1], g["azi12"], g["s12"])
    assert np.abs(geodesic.inverse(d["lat2"], d["lon2"], a[2], a[3])["s12"]).max() < 1e-7
    assert np.abs(d["area12"] - g["area12"]).max() < 1
    over = rhumb.rhumb_direct(89.0, 0.0, 10.0, 1e6)
    assert 80 < over["lat2"][0] < 90 and np.isnan(over["lon2"][0])


def test_rhumb_lengths_are_the_next_doubles():
    """Lengths by 60 digits, some within 2e-9 m of a tie of their fourth decimal."""
    lat = [60.56999999999999, -77.91, 10.219999999999999, 1.3599999999999994]
    lon = [32.83000000000001, -143.27, 105.83999999999997, 161.39]
    want = [9057343.1824500001967, 11665797.0840500015765, 1000959.8564500001958, 6387950.8461519209668]
    assert rhumb.rhumb_inverse(lat, lon, 1.36, 103.99)["s12"].tolist() == want


def test_area_under_a_line_takes_panels_by_its_length(monkeypatch):
    """The mean sine of short lines is as good with few panels: against many."""
    rng = np.random.default_rng(0)
    lat1, lat2 = rng.uniform(-89.9, 89.9, 500), rng.uniform(-89.9, 89.9, 500)
    lat2[:50] = lat1[:50] + 1e-7
    used, plain = [], rhumb.integral
    monkeypatch.setattr(rhumb, "integral", lambda g, a, b, n=2: used.append(n * len(a)) or plain(g, a, b, n))
    got = rhumb.rhumb_inverse(lat1, 0.0 * lat1, lat2, 10.0 + 0 * lat1)["area12"]
    assert sum(used) < 500 * (2 + 4)  # 2 for the meridian
    monkeypatch.setattr(rhumb, "integral", lambda g, a, b, n=2: plain(g, a, b, max(n, 40)))
    assert np.abs(got - rhumb.rhumb_inverse(lat1, 0.0 * lat1, lat2, 10.0 + 0 * lat1)["area12"]).max() < 0.1
