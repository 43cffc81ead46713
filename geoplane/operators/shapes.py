"""Auxiliary latitudes, triaxial ellipsoids and elliptic functions, as columns in Arrow batches."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import auxiliary, elliptic, triaxial_conformal, triaxial_lines
from ..functions.ellipsoid import WGS84, Ellipsoid
from ..functions.triaxial import Triaxial
from .geodesics import kernel


def latitude(lat: Column, one: str, other: str, e: Ellipsoid = WGS84) -> Column:
    """A latitude of one kind (``auxiliary.KINDS``) as one of another."""
    return kernel(lambda a: {"lat": auxiliary.convert(a, one, other, e)}, "lat", lat)["lat"]


def radii(lat: Column, azi: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct circle_radius, circle_height, meridional, transverse, normal."""
    return kernel(partial(auxiliary.radii, e=e), "circle_radius circle_height meridional transverse normal", lat, azi)


def triaxial_points(t: Triaxial, kind: str, lat: Column, lon: Column, h: Column | None = None) -> Column:
    """Struct x, y, z of geodetic (with a height), parametric, geocentric or ellipsoidal coordinates, or confocal ones (with a height)."""
    columns = (lat, lon) if h is None else (lat, lon, h)
    return kernel(getattr(t, kind), "x y z", *columns)


def triaxial_coordinates(t: Triaxial, kind: str, x: Column, y: Column, z: Column) -> Column:
    """Struct lat, lon, h (bet, omg, h of ellipsoidal and confocal ones)."""
    names = "bet omg h" if kind in ("ellipsoidal", "confocal") else "lat lon h"
    return kernel(getattr(t, f"{kind}_reverse"), names, x, y, z)


def triaxial_inverse(t: Triaxial, bet1: Column, omg1: Column, bet2: Column, omg2: Column, fields: str = "s12 azi1 azi2") -> Column:
    """Struct of the ``fields`` asked for, of s12, azi1, azi2, m12, scale12, scale21 of the shortest line between ellipsoidal coordinates; nulls where one is null or a latitude is out of range."""
    return kernel(partial(triaxial_lines.inverse, t), fields, bet1, omg1, bet2, omg2)


def triaxial_direct(t: Triaxial, bet1: Column, omg1: Column, azi1: Column, s12: Column, fields: str = "bet2 omg2 azi2") -> Column:
    """Struct of the ``fields`` asked for, of bet2, omg2, azi2, m12, scale12, scale21."""
    return kernel(partial(triaxial_lines.direct, t), fields, bet1, omg1, azi1, s12)


def conformal(t: Triaxial, bet: Column, omg: Column) -> Column:
    """Struct x, y, k of Jacobi's conformal projection."""
    return kernel(partial(triaxial_conformal.forward, t), "x y k", bet, omg)


def conformal_reverse(t: Triaxial, x: Column, y: Column) -> Column:
    """Struct bet, omg, k."""
    return kernel(partial(triaxial_conformal.reverse, t), "bet omg k", x, y)


def conformal_other(t: Triaxial, other: Triaxial, bet: Column, omg: Column) -> Column:
    """Struct bet, omg, k on another triaxial ellipsoid."""
    return kernel(partial(triaxial_conformal.to_other, t, other), "bet omg k", bet, omg)


def random_points(spark: SparkSession, t: Triaxial, n: int, parts: int = 8, seed: int = 0) -> DataFrame:
    """(x, y, z) of n points spread evenly over a surface; each part draws its own."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part, size in zip(batch.column("part").to_pylist(), batch.column("size").to_pylist()):
                p = t.random_points(size, [seed, part])
                yield pa.RecordBatch.from_arrays([pa.array(p[c]) for c in "xyz"], ["x", "y", "z"])

    sizes = spark.range(parts).select(F.col("id").alias("part"), (F.floor((F.col("id") + 1) * n / parts) - F.floor(F.col("id") * n / parts)).alias("size"))
    return sizes.repartition(parts).mapInArrow(run, "x double, y double, z double")


def elliptic_integrals(phi: Column, k2: Column, alpha2: Column) -> Column:
    """Struct F, E, D, Pi, G, H at an amplitude in radians."""
    return kernel(elliptic.incomplete, "F E D Pi G H", phi, k2, alpha2)


def jacobi(x: Column, k2: Column) -> Column:
    """Struct sn, cn, dn."""
    return kernel(elliptic.jacobi, "sn cn dn", x, k2)
