"""Gravity and magnetic models on columns of points. A model's size is checked; it goes to the workers with the function, by broadcast.

Points that share a latitude and a height share the sums over degrees: see ``by_circles``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesic import sincosd
from ..functions.harmonics import Coefficients, GravityModel, MagneticModel, NormalGravity, circles_of, harmonic_sum
from .geodesics import kernel


#: A file of coefficients may have so many bytes: degree 2190 takes 38 million.
MOST_BYTES = 256 << 20


def _content(spark: SparkSession, path: str) -> bytes:
    """A file's bytes, wherever Spark can read; its size is looked at first, as a model goes to the driver and to every worker."""
    file = spark.read.format("binaryFile").load(path)
    if (size := file.select("length").first()[0]) > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes; a model may have {MOST_BYTES}")
    return bytes(file.select("content").first()[0])


def read_gravity(spark: SparkSession, path: str, degree: int | None = None, order: int | None = None) -> GravityModel:
    """From a text of keys and values, and the coefficients beside it (``.cof``), up to a degree and an order."""
    return GravityModel.read(_content(spark, path).decode(), _content(spark, f"{path}.cof"), degree, order)


def read_magnetic(spark: SparkSession, path: str, degree: int | None = None, order: int | None = None) -> MagneticModel:
    return MagneticModel.read(_content(spark, path).decode(), _content(spark, f"{path}.cof"), degree=degree, order=order)


def by_circles(points: DataFrame, lat: str = "lat", h: str | None = "h", lon: str = "lon") -> DataFrame:
    """``points`` dealt and sorted by circle of latitude (latitude and height), for the columns below.

    These work out sums over degrees once a circle and batch of rows, and then take as much time for a point as there
    are orders, not degrees times orders. Ranges of latitude, height and longitude are dealt, so that a circle with very many
    points is cut into several tasks; rows that are equal in all of these are cut by a random number.
    """
    keys = [lat, *([h] if h else []), lon]
    return points.repartitionByRange(*keys, F.rand(0)).sortWithinPartitions(*keys)


def harmonic(k: Coefficients, radius: float, lat: Column, lon: Column, r: Column, schmidt: bool = False) -> Column:
    """Struct v, up, north, east of a sum at spherical latitudes (degrees) and distances r: the value and its gradient."""

    def run(lat, lon, r):
        (st, ct), (sl, cl) = sincosd(lat), sincosd(lon)
        g = harmonic_sum(k, radius, r * ct * cl, r * ct * sl, r * st, schmidt, circles_of(lat, r))
        x, y, z = g["gx"], g["gy"], g["gz"]
        along = x * cl + y * sl
        return {"v": g["v"], "up": along * ct + z * st, "north": z * ct - along * st, "east": y * cl - x * sl}

    return kernel(run, "v up north east", lat, lon, r)


def gravity(model: GravityModel, lat: Column, lon: Column, h: Column) -> Column:
    """Struct w (potential), east, north, up."""
    return kernel(model.gravity, "w east north up", lat, lon, h)


def disturbance(model: GravityModel, lat: Column, lon: Column, h: Column) -> Column:
    """Struct t (disturbing potential), east, north, up."""
    return kernel(model.disturbance, "t east north up", lat, lon, h)


def anomaly(model: GravityModel, lat: Column, lon: Column, h: Column) -> Column:
    """Struct dg, xi, eta, in spherical approximation."""
    return kernel(model.anomaly, "dg xi eta", lat, lon, h)


def geoid_height(model: GravityModel, lat: Column, lon: Column) -> Column:
    return kernel(lambda a, b: {"n": model.geoid_height(a, b)}, "n", lat, lon)["n"]


def normal_gravity(lat: Column, h: Column, normal: NormalGravity = NormalGravity()) -> Column:
    """Struct u (potential), north, up of an ellipsoid's own field."""
    return kernel(normal.gravity, "u north up", lat, h)


def magnetic_field(model: MagneticModel, t: Column, lat: Column, lon: Column, h: Column) -> Column:
    """Struct east, north, up (nT) and yearly changes east_t, north_t, up_t; t in years."""
    return kernel(model.field_at, "east north up east_t north_t up_t", t, lat, lon, h)


def magnetic_components(east: Column, north: Column, up: Column) -> Column:
    """Struct horizontal, total, declination, inclination."""
    h = F.hypot(east, north)
    return F.struct(h.alias("horizontal"), F.hypot(h, up).alias("total"), F.degrees(F.atan2(east, north)).alias("declination"), F.degrees(F.atan2(-up, h)).alias("inclination"))


def coefficients(table: DataFrame, most: int = 2700) -> Coefficients:
    """Coefficients of a table (n, m, c, s: degree, order, cosine, sine), one row for each n and m at most; those missing are 0.

    They go to the driver, as any model does: ``most`` bounds the degree, and so their number.
    """
    top = table.agg(F.max("n").alias("n"), F.max("m").alias("m")).first()
    if top.n is not None and top.n > most:
        raise ValueError(f"degree {top.n}; {most} is the most")
    n, m = (top.n or 0), min(top.m or 0, top.n or 0)
    c, s = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1))
    rows = table.select("n", "m", "c", "s").dropDuplicates(["n", "m"]).filter("m between 0 and n").toPandas()
    c[rows.n, rows.m], s[rows.n, rows.m] = rows.c, rows.s
    return Coefficients(c, s)
