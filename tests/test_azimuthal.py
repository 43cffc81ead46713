"""Projections by geodesics and intersections: published pairs, and back and forth."""

import numpy as np
import pytest

from geoplane.functions import azimuthal, geodesic, intersect, transverse
from geoplane.functions.ellipsoid import WGS84

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("there, back, reach", [(azimuthal.equidistant, azimuthal.equidistant_reverse, 170), (azimuthal.gnomonic, azimuthal.gnomonic_reverse, 80)])
def test_back_and_forth(there, back, reach):
    n = 500
    lat0, lon0 = RNG.uniform(-89, 89, n), RNG.uniform(-180, 180, n)
    d = geodesic.direct(lat0, lon0, RNG.uniform(-180, 180, n), RNG.uniform(0, reach, n), arc=True)
    p = there(lat0, lon0, d["lat2"], d["lon2"])
    q = back(lat0, lon0, p["x"], p["y"])
    assert geodesic.inverse(q["lat"], q["lon"], d["lat2"], d["lon2"])["s12"].max() < 1e-6
    assert np.abs(q["rk"] - p["rk"]).max() < 1e-9


def test_cassini():
    n = 500
    lat0, lon0, lat = RNG.uniform(-80, 80, n), RNG.uniform(-180, 180, n), RNG.uniform(-89, 89, n)
    lon = lon0 + RNG.uniform(-85, 85, n)
    p = azimuthal.cassini(lat0, lon0, lat, lon)
    q = azimuthal.cassini_reverse(lat0, lon0, p["x"], p["y"])
    assert geodesic.inverse(q["lat"], q["lon"], lat, lon)["s12"].max() < 1e-6
    assert np.abs(geodesic.difference(q["azi"], p["azi"])).max() < 1e-6 and np.abs(q["rk"] - p["rk"]).max() < 1e-9
    # a published pair
    p = azimuthal.cassini(48.836, 2.337, 48.648, -2.007)
    assert (p["x"][0], p["y"][0]) == pytest.approx((-319919, -11791), abs=1) and p["azi"][0] == pytest.approx(86.7, abs=0.05) and p["rk"][0] == pytest.approx(0.999, abs=5e-4)


def test_gnomonic_has_a_horizon():
    p = azimuthal.gnomonic(0.0, 0.0, 0.0, 120.0)
    assert np.isnan(p["x"][0]) and p["rk"][0] < 0


def test_transverse_mercator_is_the_series_where_that_is_good():
    lat, lon = RNG.uniform(-89, 89, 500), RNG.uniform(-35, 35, 500)
    a, b = transverse.transverse_mercator(0.0, lat, lon), transverse.transverse_mercator_exact(0.0, lat, lon)
    assert max(np.abs(a[c] - b[c]).max() for c in "xy") < 1e-6
    assert max(np.abs(a[c] - b[c]).max() for c in ("gamma", "k")) < 1e-11


def test_transverse_mercator_on_the_whole_ellipsoid():
    # published
    edge = transverse.transverse_mercator_exact(0.0, 0.0, 90.0, k0=0.9996)
    assert [round(float(edge[c][0]), 2) for c in ("x", "y", "gamma", "k")] == [25953592.85, 9997964.94, 90, 18.40]  # 25953592.84 to the digits given, cut
    lat = np.r_[RNG.uniform(-90, 90, 1000), RNG.uniform(-1, 1, 500), 90, -90, 0, 0, 0, 0, 45, 45]
    lon = np.r_[RNG.uniform(-180, 180, 1000), RNG.uniform(80, 100, 500), 10, 20, 0, 82.7, 89.999, 180, 180, -180]
    f = transverse.transverse_mercator_exact(7.0, lat, lon + 7.0)
    b = transverse.transverse_mercator_exact_reverse(7.0, f["x"], f["y"])
    assert np.hypot(b["lat"] - lat, ((b["lon"] - 7 - lon + 180) % 360 - 180) * np.cos(np.radians(lat))).max() < 1e-11
    assert np.allclose(b["k"], f["k"], rtol=1e-9) and (f["k"] >= 1 - 1e-12).all()
    # conformal: small steps north and east are equally long, and at right angles
    d, c = 1e-6, np.cos(np.radians(lat[:1000]))
    step = lambda dy, dx: transverse.transverse_mercator_exact(7.0, lat[:1000] + dy, lon[:1000] + 7.0 + dx)
    east = step(0, d / c)
    g = np.radians(f["gamma"][:1000])
    r = WGS84.a / np.sqrt(1 - WGS84.e2 * (1 - c * c)) * np.radians(d)
    ok = (np.abs(lat[:1000]) < 89) & (f["k"][:1000] < 5)
    assert np.abs((east["x"] - f["x"][:1000]) / r / f["k"][:1000] - np.cos(g))[ok].max() < 1e-4
    assert np.abs((east["y"] - f["y"][:1000]) / r / f["k"][:1000] - np.sin(g))[ok].max() < 1e-4
    odd = transverse.transverse_mercator_exact(0.0, [91.0, np.nan, 0.0], [0.0, 0.0, np.inf])
    assert all(np.isnan(v).all() for v in odd.values())


def test_published_intersections():
    g = intersect.closest(50.0, -4.0, -147.7, 0.0, 0.0, 90.0)
    assert (g["x"][0], g["y"][0], g["coincidence"][0]) == (pytest.approx(6058049, abs=1), pytest.approx(-3311253, abs=1), 0)


def test_intersections_are_on_both_lines():
    n = 200
    a = [RNG.uniform(-90, 90, n), RNG.uniform(-180, 180, n), RNG.uniform(-180, 180, n)]
    b = [RNG.uniform(-90, 90, n), RNG.uniform(-180, 180, n), RNG.uniform(-180, 180, n)]
    g = intersect.closest(*a, *b)
    p, q = geodesic.direct(*a, g["x"]), geodesic.direct(*b, g["y"])
    assert geodesic.inverse(p["lat2"], p["lon2"], q["lat2"], q["lon2"])["s12"].max() < 1e-6
    assert (np.abs(g["x"]) + np.abs(g["y"])).max() < 1.01 * np.pi * 6.4e6
    everything = intersect.within(*[v[:20] for v in a], *[v[:20] for v in b], 3e7)
    for k, found in enumerate(everything):
        lengths = [abs(x) + abs(y) for x, y, _ in found]
        assert lengths == sorted(lengths) and lengths[0] == pytest.approx(abs(g["x"][k]) + abs(g["y"][k]), abs=1e-3)
        for x, y, _ in found:
            p, q = geodesic.direct(*[v[k] for v in a], x), geodesic.direct(*[v[k] for v in b], y)
            assert geodesic.inverse(p["lat2"], p["lon2"], q["lat2"], q["lon2"])["s12"][0] < 1e-6


def test_segments_and_next():
    g = intersect.segment(0.0, 0.0, 10.0, 10.0, 0.0, 10.0, 10.0, 0.0)
    assert g["inside"][0] == 1 and g["x"][0] == pytest.approx(g["y"][0], abs=1e-6)
    assert intersect.segment(0.0, 0.0, 1.0, 1.0, 0.0, 10.0, 10.0, 0.0)["inside"][0] == 0
    same = intersect.segment([0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [10.0, 10.0, 10.0], [0.0, 0.0, 0.0], [5.0, 20.0, 8.0], [0.0, 0.0, 0.0], [15.0, 30.0, 2.0])
    assert same["inside"].tolist() == [1, 0, 1] and same["coincidence"].tolist() == [1, 1, -1]
    n = intersect.next_one(10.0, 20.0, 30.0, 80.0)
    assert 1.9e7 < abs(n["x"][0]) < 2.1e7 and 1.9e7 < abs(n["y"][0]) < 2.1e7
    s = intersect.conjugate_distance(30.0, 45.0)
    assert abs(geodesic.direct(30.0, 0.0, 45.0, s)["m12"][0]) < 1e-6 and 1.99e7 < s[0] < 2.01e7
