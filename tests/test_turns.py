"""Angles with turns, quadrants and signed zeros; auxiliary angles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoplane.functions import turns as t

CASES = [0.0, -0.0, 30.0, 45.0, 90.0, -90.0, 180.0, -180.0, 270.0, 360.0, -360.0, 540.0, -540.0, 720.0, 1e-300, 123.456, -1234.5, 99999.0]


def column(spark, values, f, kind="double"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-15, abs=1e-13) and math.copysign(1, a) == math.copysign(1, b), (a, b)


def test_degrees_come_back(spark):
    same(column(spark, CASES, lambda v: t.degrees(t.turn(v))), CASES)
    got = column(spark, CASES, t.turn)
    assert [(r.s, r.c) for r in got[2:5]] == [(0.5, 0.75**0.5), (0.5**0.5, 0.5**0.5), (1.0, 0.0)]
    same([r.s for r in got[:2] + got[6:8]], [0.0, -0.0, 0.0, -0.0])
    same([r.c for r in got[4:6]], [0.0, 0.0])
    assert [r.n for r in got] == [0, 0, 0, 0, 0, 0, 0, 0, 1, 1, -1, 1, -1, 2, 0, 0, -3, 278]


def test_odd_values(spark):
    got = column(spark, [None, float("nan"), float("inf"), -float("inf")], t.turn)
    assert got[0] is None and all(math.isnan(x) for r in got[1:] for x in (r.s, r.c, r.n))


def test_sums(spark):
    pairs = [(a, b) for a in CASES for b in CASES if abs(a) < 1e4 and abs(b) < 1e4]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double").orderBy("i")
    a, b = t.turn(F.col("a")), t.turn(F.col("b"))
    got = rows.select(t.degrees(t.plus(a, b)).alias("sum"), t.degrees(t.less(a, b)).alias("less"), t.degrees(t.rebase(a, b)).alias("near")).collect()
    for (x, y), r in zip(pairs, got):
        assert r["sum"] == pytest.approx(x + y, abs=1e-11) and r.less == pytest.approx(x - y, abs=1e-11)
        assert abs(r.near - y) <= 180 + 1e-11 and abs(math.remainder(r.near - x, 360)) < 1e-11
    zero = rows.filter("b = 0").select("a", t.degrees(t.plus(a, b)).alias("s")).collect()
    same([r.s for r in zero], [r.a for r in zero])


def test_quadrants(spark):
    values = [0.0, 10.0, 90.0, 100.0, 180.0, -180.0, -100.0, -90.0, -10.0, -0.0, 400.0]
    assert column(spark, values, lambda v: t.quadrant(t.turn(v))) == [0, 0, 0, 1, 1, 2, 2, 3, 3, 3, 0]
    same(column(spark, values, lambda v: t.degrees(t.nearest(t.turn(v)))), [0.0, 0.0, 90.0, 90.0, 180.0, -180.0, -90.0, -90.0, -0.0, -0.0, 360.0])
    assert column(spark, values, lambda v: t.quarters(t.turn(v))) == [0, 0, 1, 1, 2, -2, -1, -1, 0, 0, 4]
    same(column(spark, [0.0, 1.0, 2.0, 3.0], lambda v: t.degrees(t.with_quadrant(t.turn(F.lit(10.0)), v))), [10.0, 170.0, -170.0, -10.0])
    same(column(spark, [-1.0, 0.0, 1.0, 2.0, 5.0], lambda v: t.degrees(t.cardinal(v))), [-90.0, 0.0, 90.0, 180.0, 450.0])
    same(column(spark, [20.0], lambda v: t.degrees(t.reflect(t.turn(v), flip_c=True))), [160.0])
    same(column(spark, [20.0], lambda v: t.degrees(t.reflect(t.turn(v), swap=True))), [70.0])
    same(column(spark, [0.0, 0.5, 1.0, 4.0], lambda m: t.degrees(t.stretched(t.turn(F.lit(135.0)), m))), [180.0, *(180 - math.degrees(math.atan(m)) for m in (0.5, 1.0, 4.0))])
    same(column(spark, [3.0, -3.0], lambda v: t.degrees(t.of_sides(v, F.lit(-3.0), 2.0))), [855.0, 585.0])


def test_texts(spark):
    got = column(spark, ["40d30'N", "20:30+1:30", "x"], lambda v: t.degrees(t.of_text(v)), "string")
    assert got == [40.5, 22.0, None]
    rows = spark.createDataFrame([(0, "E44d24", "N33d20"), (1, "33.5", "44.5"), (2, "1N", "2N")], "i int, a string, b string").orderBy("i")
    places = [r[0] for r in rows.select(t.of_lat_lon(F.col("a"), F.col("b")).alias("p")).collect()]
    assert places[0].lat.s == pytest.approx(math.sin(math.radians(33 + 1 / 3))) and places[1].lon.c == pytest.approx(math.cos(math.radians(44.5))) and places[2] is None
    assert column(spark, ["10E", "10N"], lambda v: t.degrees(t.of_azimuth(v)), "string") == [10.0, None]


def test_auxiliary(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate([(3.0, 4.0), (0.0, 0.0), (inf, 1.0), (1.0, -inf), (inf, inf), (nan, 1.0), (-0.0, -2.0), (2.0, 0.0), (-2.0, 0.0)])], "i int, y double, x double").orderBy("i")
    a = t.auxiliary(F.col("y"), F.col("x"))
    got = rows.select(t.normalized(a).alias("u"), t.tangent(a).alias("t"), t.auxiliary_degrees(a).alias("d"), t.auxiliary_plus(a, t.auxiliary(F.lit(1.0), F.lit(1.0))).alias("s"), t.auxiliary_plus(a, t.auxiliary(F.lit(0.0), F.lit(5.0))).alias("z")).collect()
    assert tuple(got[0].u) == (0.6, 0.8) and got[0].t == 0.75 and tuple(got[0].s) == (7.0, 1.0) and tuple(got[0].z) == (3.0, 4.0)
    assert all(math.isnan(v) for i in (1, 4, 5) for v in got[i].u) and tuple(got[2].u) == (1.0, 0.0) and tuple(got[3].u) == (0.0, -1.0)
    assert math.isnan(got[1].t) and (got[7].t, got[8].t) == (inf, -inf) and (got[6].d, got[7].d) == (-180.0, 90.0)
    same([got[6].z.y, got[6].z.x], [-0.0, -2.0])
    like = rows.select(t.auxiliary_like(t.auxiliary(F.lit(1.0), F.lit(2.0)), a).alias("q")).collect()
    assert tuple(like[6].q) == (-1.0, -2.0) and np.allclose(column(spark, [30.0], t.auxiliary_of)[0], (0.5, 0.75**0.5))
