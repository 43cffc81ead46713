"""Triaxial coordinates: a published pair, and back and forth."""

import numpy as np
import pytest

from geoplane.functions.ellipsoid import WGS84
from geoplane.functions.triaxial import Triaxial

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("t", [Triaxial(), Triaxial(3.0, 2.0, 1.0)])
def test_back_and_forth(t):
    lat, lon = RNG.uniform(-90, 90, 300), RNG.uniform(-180, 180, 300)
    h = RNG.uniform(-0.05, 3, 300) * t.c
    g = t.geodetic_reverse(*t.geodetic(lat, lon, h).values())
    assert np.allclose(g["lat"], lat, atol=1e-9) and np.allclose(g["lon"], lon, atol=1e-7) and np.allclose(g["h"], h, atol=1e-9 * t.a)
    for there, back in ((t.parametric, t.parametric_reverse), (t.geocentric, t.geocentric_reverse)):
        p = there(lat, lon)
        assert np.allclose((p["x"] / t.a) ** 2 + (p["y"] / t.b) ** 2 + (p["z"] / t.c) ** 2, 1)
        q = back(*p.values())
        assert np.allclose(q["lat"], lat, atol=1e-8) and np.allclose(q["lon"], lon, atol=1e-7)
    p = t.ellipsoidal(lat, lon)
    assert np.allclose((p["x"] / t.a) ** 2 + (p["y"] / t.b) ** 2 + (p["z"] / t.c) ** 2, 1)
    q = t.ellipsoidal(*list(t.ellipsoidal_reverse(*p.values()).values())[:2])
    assert all(np.allclose(p[c], q[c], atol=1e-6 * t.a) for c in "xyz")


def test_published_pair():
    t = Triaxial(3.0, 2.0, 1.0)
    q = t.confocal_reverse(1.0, 2.0, 3.0)
    assert (q["bet"][0], q["omg"][0], q["h"][0]) == pytest.approx((58.69140, 75.11263, 2.5860649), abs=6e-6)
    assert [float(v[0]) for v in t.confocal(q["bet"], q["omg"], q["h"]).values()] == pytest.approx([1, 2, 3])
    r, h = t.foot(1.0, 2.0, 3.0)
    gap = np.array([1.0, 2.0, 3.0]) - r[:, 0]
    assert np.linalg.norm(gap) == pytest.approx(h[0]) and np.allclose(np.cross(gap, r[:, 0] / t.axes2), 0, atol=1e-9)


def test_two_equal_axes_are_the_ellipsoid():
    t = Triaxial(WGS84.a, WGS84.a, WGS84.b)
    p = t.geodetic(40.0, 30.0, 100.0)
    n = WGS84.a / np.sqrt(1 - WGS84.e2 * np.sin(np.radians(40)) ** 2)
    assert p["z"][0] == pytest.approx(((1 - WGS84.e2) * n + 100) * np.sin(np.radians(40)))


def test_random_points():
    t = Triaxial(3.0, 2.0, 1.0)
    p = t.random_points(20000)
    assert np.allclose((p["x"] / 3) ** 2 + (p["y"] / 2) ** 2 + p["z"] ** 2, 1)
    lat, lon = np.meshgrid((np.arange(400) + 0.5) / 400 * np.pi - np.pi / 2, (np.arange(400) + 0.5) / 400 * 2 * np.pi)
    area = np.cos(lat) * np.sqrt((2 * np.cos(lat) * np.cos(lon)) ** 2 + (3 * np.cos(lat) * np.sin(lon)) ** 2 + (6 * np.sin(lat)) ** 2)
    assert (np.abs(p["z"]) > 0.5).mean() == pytest.approx(area[np.abs(np.sin(lat)) > 0.5].sum() / area.sum(), abs=0.015)
