"""Geodesic and rhumb operators on DataFrames: columns of points in, struct columns out, in Arrow batches."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import geodesic, rhumb
from ..functions.ellipsoid import WGS84, Ellipsoid


def kernel(f, names: str, *columns: Column) -> Column:
    """A struct of doubles ``names``, by a NumPy function of the columns that gives a dict; nulls are NaN to it."""

    def run(*series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(f(*(v.to_numpy(dtype="float64", na_value=float("nan")) for v in series)))[names.split()]

    return pandas_udf(run, ", ".join(f"{n} double" for n in names.split()))(*columns)


def inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column, e: Ellipsoid = WGS84, fields: str = "s12 azi1 azi2") -> Column:
    """Struct of the ``fields`` asked for, of s12, a12, azi1, azi2, m12, scale12, scale21, area12; NaN where a coordinate is null or out of range."""
    return kernel(partial(geodesic.inverse, e=e, fields=tuple(fields.split())), fields, lat1, lon1, lat2, lon2)


def direct(lat1: Column, lon1: Column, azi1: Column, s12: Column, e: Ellipsoid = WGS84, fields: str = "lat2 lon2 azi2", arc: bool = False, unroll: bool = False) -> Column:
    """Struct of the ``fields`` asked for, of lat2, lon2, azi2, s12, a12, m12, scale12, scale21, area12.

    With ``arc``, s12 is in degrees of arc; with ``unroll``, lon2 tells how often and which way the line goes round.
    """
    return kernel(partial(geodesic.direct, e=e, arc=arc, unroll=unroll, fields=tuple(fields.split())), fields, lat1, lon1, azi1, s12)


def line_arc(lat1: Column, lon1: Column, azi1: Column, s12: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct azi0, a1, a13: azimuth at the equator's crossing, arc from there to the first point, and arc for the distance s12."""

    def run(lat1, lon1, azi1, s12):
        line = geodesic.GeodesicLine(lat1, lon1, azi1, e).set_distance(s12)
        return {"azi0": line.equatorial_azimuth, "a1": line.equatorial_arc, "a13": line.arc}

    return kernel(run, "azi0 a1 a13", lat1, lon1, azi1, s12)


def rhumb_inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column, e: Ellipsoid = WGS84, area: bool = False) -> Column:
    """Struct azi12, s12 (and area12, the area under the line)."""
    return kernel(partial(rhumb.rhumb_inverse, e=e, area=area), "azi12 s12" + " area12" * area, lat1, lon1, lat2, lon2)


def rhumb_direct(lat1: Column, lon1: Column, azi12: Column, s12: Column, e: Ellipsoid = WGS84, area: bool = False, unroll: bool = False) -> Column:
    """Struct lat2, lon2 (and area12)."""
    return kernel(partial(rhumb.rhumb_direct, e=e, area=area, unroll=unroll), "lat2 lon2" + " area12" * area, lat1, lon1, azi12, s12)


def waypoints(lines: DataFrame, n: int, e: Ellipsoid = WGS84) -> DataFrame:
    """``lines`` (lat1, lon1, lat2, lon2) repeated for k = 0 .. n, with the point at k / n of the geodesic: lat, lon, azi."""
    ends = lines.withColumn("_g", inverse(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), e))
    each = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    at = direct(F.col("lat1"), F.col("lon1"), F.col("_g.azi1"), F.col("_g.s12") * F.col("k") / n, e)
    return each.withColumn("_p", at).select(*lines.columns, "k", F.col("_p.lat2").alias("lat"), F.col("_p.lon2").alias("lon"), F.col("_p.azi2").alias("azi"))


def waypoints_by_distance(lines: DataFrame, step: float, e: Ellipsoid = WGS84) -> DataFrame:
    """``lines`` repeated for the points at 0, step, 2 step, ... metres up to the end, which comes last if it is none of these: k, s, lat, lon, azi."""
    ends = lines.withColumn("_g", inverse(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), e))
    last = F.ceil(F.col("_g.s12") / step).cast("int")
    each = ends.filter(~F.isnan("_g.s12")).withColumn("k", F.explode(F.sequence(F.lit(0), last))).withColumn("s", F.least(F.col("k") * step, F.col("_g.s12")))
    at = direct(F.col("lat1"), F.col("lon1"), F.col("_g.azi1"), F.col("s"), e)
    return each.withColumn("_p", at).select(*lines.columns, "k", "s", F.col("_p.lat2").alias("lat"), F.col("_p.lon2").alias("lon"), F.col("_p.azi2").alias("azi"))


def track_lengths(points: DataFrame, track: str, order: list[str], e: Ellipsoid = WGS84) -> DataFrame:
    """``points`` (lat, lon) with step, the distance from the point before on the track, and so_far, their running sum."""
    w = Window.partitionBy(track).orderBy(*order)
    before = points.withColumn("_lat", F.lag("lat").over(w)).withColumn("_lon", F.lag("lon").over(w))
    step = F.when(F.col("_lat").isNull(), F.lit(0.0)).otherwise(inverse(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"), e, "s12")["s12"])
    return before.withColumn("step", step).withColumn("so_far", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_lat", "_lon")
