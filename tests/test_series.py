"""Series of sines and of periods: known coefficients, refinement, integrals against quadrature, inverses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoplane.functions import series
from geoplane.operators.series import fitted, period_inverse


def bump(s, k):
    return np.exp(k * np.cos(s - 1))


def odd(s, k):
    return np.sin(s) / (1.1 - k * np.sin(s) ** 2)


def test_transforms_give_coefficients():
    c = np.array([1.0, -0.5, 0.25, 0.1])
    s = np.arange(1, 9) * np.pi / 16
    assert np.allclose(series.sine_transform((c[:, None] * np.sin((2 * np.arange(4)[:, None] + 1) * s)).sum(axis=0)), np.r_[c, np.zeros(4)], atol=1e-15)
    s = np.arange(16) * np.pi / 8
    a, b = series.period_transform(2 - 3 * np.cos(s) + 0.5 * np.sin(2 * s) + 0.25 * np.cos(8 * s))
    assert np.allclose(a, [2, -3, 0, 0, 0, 0, 0, 0, 0.25]) and np.allclose(b, np.r_[0, 0, 0.5, np.zeros(6)])


def test_fits_grow_as_needed():
    fits = series.fit_sines(odd, [0.0, 0.5, 1.0, np.nan])
    assert [len(c) for c in fits[:3]] == sorted(len(c) for c in fits[:3]) and len(fits[0]) == 8 < len(fits[2]) and np.isnan(fits[3]).all()
    for k, c in zip((0.0, 0.5, 1.0), fits):
        assert (c * np.sin((2 * np.arange(len(c)) + 1) * 0.7)).sum() == pytest.approx(odd(0.7, k), abs=1e-12)
    assert len(series.fit_period(lambda s, k: np.sign(np.sin(s)) * k, 1.0)[0]) == 2 * series.MOST + 1  # no end to its tail: the most there are


def test_columns_and_inverses(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, -4.0), (5.0, 9.0), (None, 1.0)], "k double, s double").coalesce(1)
    # functions of a test module can't be imported by the workers
    one, two = (lambda s, k: np.exp(k * np.cos(s - 1))), (lambda s, k: np.sin(s) / (1.1 - k * np.sin(s) ** 2))
    rows = df.withColumn("c", fitted(one, F.col("k"))).withColumn("o", fitted(two, F.col("k") / 10, sines=True)).collect()
    df = spark.createDataFrame(rows, "k double, s double, c array<double>, o array<double>")
    df = df.withColumn("y", series.period_integral(F.col("c"), F.col("s")))
    got = df.select("k", "s", "y", series.period(F.col("c"), F.col("s")).alias("v"), series.sines(F.col("o"), F.col("s")).alias("w"), series.sines_integral(F.col("o"), F.col("s")).alias("z"), period_inverse(F.col("c"), F.col("y")).alias("back")).collect()
    x, w = np.polynomial.legendre.leggauss(200)
    for r in got:
        if r.k is None:
            assert r.back is None or np.isnan(r.back)
            continue
        s = (x + 1) / 2 * r.s
        assert (r.v, r.y) == pytest.approx((bump(r.s, r.k), (w * bump(s, r.k)).sum() * r.s / 2), rel=1e-12)
        assert (r.w, r.z) == pytest.approx((odd(r.s, r.k / 10), (w * odd(s, r.k / 10)).sum() * r.s / 2), abs=1e-12)
        assert r.back == pytest.approx(r.s, abs=1e-11)
