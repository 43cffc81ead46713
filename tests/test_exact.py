"""Published values of angles at their edges, with signs of zeros; sums with errors kept."""

import math

import numpy as np
import pytest

from geoplane.functions import exact
from geoplane.operators.sums import accurate_sums

EPS, INF, NAN = np.finfo(float).eps, math.inf, math.nan


def same(got, want):
    got, want = np.broadcast_arrays(np.asarray(got, float), np.asarray(want, float))
    assert ((got == want) & (np.signbit(got) == np.signbit(want)) | (np.isnan(got) & np.isnan(want))).all(), (got, want)


def test_rounding():
    z = [(-EPS / 32, -EPS / 32), (-EPS / 64, -0.0), (-0.0, -0.0), (0.0, 0.0), (EPS / 64, 0.0), (EPS / 32, EPS / 32)]
    z += [((1 - 2 * EPS) / 64, (1 - 2 * EPS) / 64), ((1 - EPS) / 64, 1 / 64), ((1 + EPS) / 64, 1 / 64), ((1 + 2 * EPS) / 64, (1 + 2 * EPS) / 64), ((1 - EPS) / 32, (1 - EPS) / 32), ((1 - EPS / 2) / 32, 1 / 32)]
    z += [((1 + EPS) / 32, (1 + EPS) / 32), ((1 - EPS / 2) / 16, (1 - EPS / 2) / 16), ((1 + EPS) / 16, (1 + EPS) / 16), ((1 - EPS / 2) / 8, (1 - EPS / 2) / 8), (1 - EPS, 1 - EPS), (90 - 64 * EPS, 90 - 64 * EPS), (90.0, 90.0)]
    same(exact.ang_round([a for a, _ in z]), [b for _, b in z])


def test_quadrants():
    with np.errstate(invalid="ignore"):
        x = [-INF, -810, -720, -630, -540, -450, -360, -270, -180, -90, -0.0, 0, 90, 180, 270, 360, 450, 540, 630, 720, 810, INF, NAN]
        s = [NAN, -1, -0.0, 1, -0.0, -1, -0.0, 1, -0.0, -1, -0.0, 0, 1, 0, -1, 0, 1, 0, -1, 0, 1, NAN, NAN]
        c = [NAN, 0, 1, 0, -1, 0, 1, 0, -1, 0, 1, 1, 0, -1, 0, 1, 0, -1, 0, 1, 0, NAN, NAN]
        o = exact.OVERFLOW
        t = [NAN, -o, -0.0, o, 0, -o, -0.0, o, 0, -o, -0.0, 0, o, -0.0, -o, 0, o, -0.0, -o, 0, o, NAN, NAN]
        got = exact.exact_trig(np.array(x, float))
    same(got["sin"], s)
    same(got["cos"], c)
    same(got["tan"], t)
    (s1, c1), (s2, c2), (s3, c3) = (exact.sincosd(v) for v in (9.0, 81.0, -123456789.0))
    same([s1, c1, s1, c1], [c2, s2, s3, -c3])


def test_directions():
    z = [(0.0, -0.0, 180), (-0.0, -0.0, -180), (0.0, 0.0, 0.0), (-0.0, 0.0, -0.0), (0.0, -1, 180), (-0.0, -1, -180), (-1, 0.0, -90), (-1, -0.0, -90), (1, 0.0, 90), (1, -0.0, 90), (1, -INF, 180), (-1, -INF, -180), (1, INF, 0.0), (-1, INF, -0.0)]
    z += [(INF, 1, 90), (INF, -1, 90), (-INF, 1, -90), (-INF, -1, -90), (INF, -INF, 135), (-INF, -INF, -135), (INF, INF, 45), (-INF, INF, -45), (NAN, 1, NAN), (1, NAN, NAN)]
    same(exact.atan2d([a for a, _, _ in z], [b for _, b, _ in z]), [c for *_, c in z])
    same(exact.atan2d(7e-16, -1), 180 - exact.atan2d(7e-16, 1))
    same(exact.normalized([-900.0, -720.0, -540.0, -360.0, -180.0, -0.0, 0.0, 180.0, 360.0, 540.0, 720.0, 900.0]), [-180, -0.0, -180, -0.0, -180, -0.0, 0, 180, 0, 180, 0, 180])
    d = [(0.0, 0.0, 0.0), (0.0, -0.0, -0.0), (-0.0, 0.0, 0.0), (-0.0, -0.0, 0.0), (5.0, 365.0, 0.0), (365.0, 5.0, -0.0), (5.0, 185.0, 180), (185.0, 5.0, -180), (EPS, 180.0, 180), (-EPS, 180.0, -180), (EPS, -180.0, 180), (-EPS, -180.0, -180)]
    same(exact.difference([a for a, _, _ in d], [b for _, b, _ in d]), [c for *_, c in d])
    same(exact.difference(138 + 128 * EPS, -164.0), 58 - 128 * EPS)


def test_sums_and_polynomials():
    same([exact.two_sum(np.float64(a), np.float64(b))[0] for a, b in ((9.0, -9.0), (-0.0, 0.0), (-0.0, -0.0))], [0.0, 0.0, -0.0])
    a = exact.Accumulator()
    for v in (1e16, 1.0, 1e-9, -1e16):
        a.add(v)
    assert a.value() == 1 + 1e-9 and a.value(1.0) == pytest.approx(2 + 1e-9) and exact.Accumulator(725.0).remainder(360.0).value() == 5
    assert exact.Accumulator(0.1, 1e-20).scaled(3).value() == pytest.approx(0.3)
    assert exact.polynomial([1, 2, 3], np.array([2.0])).tolist() == [11] and exact.polynomial([], np.array([2.0])).tolist() == [0]


def test_sums_by_key(spark):
    rows = [("a", v) for v in (1e16, 1.0, -1e16, 1e-3)] + [("b", None), ("b", 2.5)]
    got = {r.k: (r["sum"], r["rest"]) for r in accurate_sums(spark.createDataFrame(rows, "k string, v double").repartition(3), "k", "v").collect()}
    assert got["a"][0] == 1.001 and got["b"] == (2.5, 0.0)
