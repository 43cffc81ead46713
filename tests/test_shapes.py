"""Auxiliary latitudes and shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoplane.functions import auxiliary as aux
from geoplane.functions.ellipsoid import WGS84, Ellipsoid
from geoplane.functions.triaxial import Triaxial
from geoplane.operators import shapes


@pytest.mark.parametrize("kind", aux.KINDS)
@pytest.mark.parametrize("e", [WGS84, Ellipsoid(6.4e6, 1 / 50)])
def test_latitudes_come_back(kind, e):
    lat = np.linspace(-89.9, 89.9, 200)
    there = aux.from_geographic(lat, kind, e)
    assert np.abs(aux.to_geographic(there, kind, e) - lat).max() < 1e-8 and (np.diff(there) > 0).all()
    assert aux.from_geographic(90.0, kind, e)[0] == pytest.approx(90)
    step = aux.divided_difference(lat[:-1], lat[1:], kind, e)
    assert np.allclose(step, np.diff(there) / np.diff(lat), rtol=1e-6) and np.allclose(aux.divided_difference(lat, lat, kind, e), aux.divided_difference(lat - 1e-4, lat + 1e-4, kind, e), rtol=1e-5)


def test_measures():
    m = aux.measures()
    # Fixed values of the world geodetic system of 1984
    assert m["quarter_meridian"] == pytest.approx(10001965.729, abs=1e-3) and m["authalic_radius"] == pytest.approx(6371007.1809, abs=1e-4) and m["volume"] == pytest.approx(1.0832073e21, rel=1e-7)
    r = aux.radii([0.0, 90.0], 0.0)
    assert r["normal"] == pytest.approx([6335439.327, 6399593.626], abs=1e-3) and r["circle_height"][1] == pytest.approx(WGS84.b)


def test_columns(spark):
    t = Triaxial(3.0, 2.0, 1.0)
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    p = df.select(shapes.triaxial_coordinates(t, "confocal", F.col("x"), F.col("y"), F.col("z")).alias("c"), shapes.latitude(F.col("x") * 40, "geographic", "rectifying").alias("mu"), shapes.jacobi(F.col("x"), F.lit(0.5)).alias("j"), shapes.elliptic_integrals(F.col("x"), F.lit(0.5), F.lit(0.1)).alias("i"), shapes.triaxial_points(t, "geodetic", F.col("x"), F.col("y"), F.col("z")).alias("g")).first()
    assert p.c.bet == pytest.approx(58.6914, abs=1e-5) and p.mu == pytest.approx(39.8577, abs=1e-3) and p.j.sn == pytest.approx(0.8030, abs=1e-4) and p.i.F == pytest.approx(1.0832, abs=1e-3) and p.g.x > 3
    assert shapes.random_points(spark, t, 1001, 4).count() == 1001
