"""Intersections of geodesics, given in columns by points and azimuths."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import intersect
from ..functions.ellipsoid import WGS84, Ellipsoid
from .geodesics import kernel


def closest(lat_x: Column, lon_x: Column, azi_x: Column, lat_y: Column, lon_y: Column, azi_y: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y (displacements along the two lines), coincidence (1, -1 where they run along each other) of the closest intersection."""
    return kernel(partial(intersect.closest, e=e), "x y coincidence", lat_x, lon_x, azi_x, lat_y, lon_y, azi_y)


def segment(lat_x1: Column, lon_x1: Column, lat_x2: Column, lon_x2: Column, lat_y1: Column, lon_y1: Column, lat_y2: Column, lon_y2: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y, coincidence, inside (1 if the meeting is within both segments)."""
    return kernel(partial(intersect.segment, e=e), "x y coincidence inside", lat_x1, lon_x1, lat_x2, lon_x2, lat_y1, lon_y1, lat_y2, lon_y2)


def next_one(lat: Column, lon: Column, azi_x: Column, azi_y: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y, coincidence of the next closest intersection of lines that meet at a point."""
    return kernel(partial(intersect.next_one, e=e), "x y coincidence", lat, lon, azi_x, azi_y)


def distance(x: Column, y: Column, x0: Column | float = 0.0, y0: Column | float = 0.0) -> Column:
    """How far an intersection is: the sum of both displacements' sizes."""
    return F.abs(x - x0) + F.abs(y - y0)


def all_within(lines: DataFrame, most: float, e: Ellipsoid = WGS84) -> DataFrame:
    """``lines`` (lat_x, lon_x, azi_x, lat_y, lon_y, azi_y) repeated for each intersection at most ``most`` metres far: rank, x, y, coincidence."""

    def run(*series: pd.Series) -> pd.Series:
        found = intersect.within(*(v.to_numpy(dtype="float64", na_value=float("nan")) for v in series), most, e)
        return pd.Series([[{"x": x, "y": y, "coincidence": c} for x, y, c in row] for row in found])

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    each = pandas_udf(run, "array<struct<x:double,y:double,coincidence:double>>")(*(f"{c}_{k}" for k in "xy" for c in ("lat", "lon", "azi")))
    out = lines.select("*", F.posexplode(each).alias("_k", "_i"))
    return out.select(*lines.columns, (F.col("_k") + 1).alias("rank"), "_i.x", "_i.y", "_i.coincidence")
