"""Harmonic sums, normal gravity, model files made up here, geoid grids, elliptic functions."""

import math

import numpy as np
import pytest

from geoplane.functions import elliptic, harmonics as h
from geoplane.functions.ellipsoid import WGS84, Ellipsoid

RNG = np.random.default_rng(0)


def test_sums_have_their_gradients():
    k = h.Coefficients(np.tril(RNG.normal(size=(7, 7))), np.tril(RNG.normal(size=(7, 7)), 0))
    k.s[:, 0] = 0
    x, y, z = RNG.normal(size=(3, 50)) * 2 + 3
    for schmidt in (False, True):
        g = h.harmonic_sum(k, 1.5, x, y, z, schmidt)
        d = 1e-5
        for c, (dx, dy, dz) in (("gx", (d, 0, 0)), ("gy", (0, d, 0)), ("gz", (0, 0, d))):
            slope = (h.harmonic_sum(k, 1.5, x + dx, y + dy, z + dz, schmidt)["v"] - h.harmonic_sum(k, 1.5, x - dx, y - dy, z - dz, schmidt)["v"]) / (2 * d)
            assert np.allclose(g[c], slope, rtol=1e-6, atol=1e-7)
    point = h.Coefficients(np.array([[1.0]]), np.zeros((1, 1)))
    g = h.harmonic_sum(point, 1.0, [0.0], [0.0], [2.0])
    assert g["v"][0] == 0.5 and g["gz"][0] == pytest.approx(-0.25)
    again = h.Coefficients.read(__import__("io").BytesIO(k.written()))
    assert (again.c == k.c).all() and (again.s == k.s).all()
    assert (k.plus(point, 2.0).c[0, 0], k.plus(point).c[3, 2]) == (k.c[0, 0] + 2, k.c[3, 2])


def test_normal_gravity():
    n = h.NormalGravity()
    k = n.constants
    # Fixed values of the world geodetic system of 1984
    assert k["gamma_e"] == pytest.approx(9.7803253359, abs=2e-10) and k["gamma_p"] == pytest.approx(9.8321849378, abs=2e-9) and k["u0"] == pytest.approx(62636851.7146, abs=1e-3)
    lat = RNG.uniform(-90, 90, 50)
    g = n.gravity(lat, 0.0)
    assert np.allclose(g["u"], k["u0"], rtol=1e-14) and np.allclose(-g["up"], n.surface(lat), rtol=1e-13) and np.abs(g["north"]).max() < 1e-11
    assert h.NormalGravity.from_j2(n.e.a, n.gm, n.omega, k["j2"]).e.f == pytest.approx(WGS84.f, abs=1e-14)
    high = n.gravity(45.0, 1000.0)
    assert 9.80 < -high["up"][0] < 9.806 and high["north"][0] != 0


def gravity_files():
    n = h.NormalGravity()
    k, more = h.Coefficients(np.zeros((5, 5)), np.zeros((5, 5))), h.Coefficients(np.zeros((2, 2)), np.zeros((2, 2)))
    k.c[2, 0] = -n.constants["j2"] / math.sqrt(5)
    k.c[3, 1], k.s[4, 3] = 2e-6, -1e-6
    more.c[0, 0] = 0.5
    text = f"EGMF-1\n# made up\nName small\nModelRadius 6378137\nModelMass {n.gm}\nAngularVelocity {n.omega}\nReferenceRadius {n.e.a}\nReferenceMass {n.gm}\nFlattening 1/298.257223563\nHeightOffset -0.25\nCorrectionMultiplier 0.5\nNormalization full\nID SMALL001\n"
    return text, b"SMALL001" + k.written() + more.written()


def test_gravity_model():
    m = h.GravityModel.read(*gravity_files())
    lat, lon = RNG.uniform(-89, 89, 40), RNG.uniform(-180, 180, 40)
    g = m.gravity(lat, lon, 100.0)
    assert np.allclose(np.sqrt(g["east"] ** 2 + g["north"] ** 2 + g["up"] ** 2), -m.normal.gravity(lat, 100.0)["up"], rtol=1e-4)
    d = m.disturbance(lat, lon, 0.0)
    assert np.abs(d["t"]).max() < 1000 and np.allclose(m.geoid_height(lat, lon), d["t"] / m.normal.surface(lat) + 0.25 - 0.25)
    xyz, _ = h._frame(lat, lon, 0.0 * lat, m.normal.e)
    p = m.potentials(*xyz)
    assert np.allclose(p["w"], p["v"] + p["phi"]) and np.allclose(p["t"], d["t"], atol=1e-6)
    a = m.anomaly(lat, lon, 0.0)
    assert np.abs(a["dg"]).max() < 1e-3 and np.abs(a["xi"]).max() < 0.01
    text, data = gravity_files()
    with pytest.raises(ValueError):
        h.GravityModel.read(text, b"OTHER001" + data[8:])


def test_magnetic_model():
    one, two, rate = (h.Coefficients(np.zeros((2, 2)), np.zeros((2, 2))) for _ in range(3))
    one.c[1, 0], two.c[1, 0], rate.c[1, 0] = -30000.0, -29000.0, 100.0
    text = "WMMF-1\nRadius 6371200\nEpoch 2000\nDeltaEpoch 5\nNumModels 2\nMinTime 2000\nMaxTime 2010\nMinHeight -1000\nMaxHeight 600000\nID DIPOLE01\n"
    m = h.MagneticModel.read(text, b"DIPOLE01" + one.written() + two.written() + rate.written())
    f = m.field_at([2000.0, 2002.5, 2005.0, 2007.0], 0.0, 10.0, 6371200 - 6378137.0)
    assert np.allclose(f["north"], [30000, 29500, 29000, 28800]) and np.allclose(f["north_t"], [-200, -200, -100, -100]) and np.abs(f["east"]).max() < 1e-9
    pole = m.field_at(2000.0, 90.0, 0.0, 0.0)
    c = h.field_components(pole["east"], pole["north"], pole["up"])
    assert c["inclination"][0] == pytest.approx(90, abs=1e-3) and c["total"][0] > 5e4
    assert h.field_components(1.0, 1.0, -1.0)["declination"] == pytest.approx(45) and m.is_valid([1999.0, 2005.0, 2005.0], [0, 0, 1e6]).tolist() == [False, True, False]


def test_elliptic():
    # Fixed values of tables
    c = elliptic.complete(0.5)
    assert (c["K"][0], c["E"][0]) == pytest.approx((1.8540746773013719, 1.3506438810476755), abs=1e-14)
    i = elliptic.incomplete(math.pi / 3, 0.25)
    assert i["F"][0] == pytest.approx(1.0895506700518853, abs=1e-9)
    phi = RNG.uniform(-6, 6, 40)
    n = 20000
    t = (np.arange(n) + 0.5) / n
    for k2, a2 in ((0.3, 0.4), (-2.0, -0.5), (0.9, 0.0)):
        s2 = np.sin(phi[:, None] * t) ** 2
        delta = np.sqrt(1 - k2 * s2)
        got = elliptic.incomplete(phi, k2, a2)
        want = {"F": 1 / delta, "E": delta, "D": s2 / delta, "Pi": 1 / delta / (1 - a2 * s2), "G": delta / (1 - a2 * s2), "H": np.cos(phi[:, None] * t) ** 2 / delta / (1 - a2 * s2)}
        for name, v in want.items():
            assert np.allclose(got[name], v.mean(axis=1) * phi, atol=1e-6), name
        assert np.allclose(elliptic.amplitude(got["F"], k2), phi, atol=1e-10)
        assert np.allclose(elliptic.inverse_e(got["E"], k2), phi, atol=1e-10)
        j = elliptic.jacobi(got["F"], k2)
        assert np.allclose(j["sn"], np.sin(phi), atol=1e-10) and np.allclose(j["dn"] ** 2 + k2 * j["sn"] ** 2, 1)
    assert elliptic.rc(1, 2)[0] == pytest.approx(math.pi / 4) and elliptic.rj(2, 3, 4, 5)[0] == pytest.approx(0.14297579667156753833, abs=1e-12) and elliptic.rd(0, 2, 1)[0] == pytest.approx(1.7972103521033883112, abs=1e-12) and elliptic.rg(0, 16, 16)[0] == pytest.approx(math.pi)
