"""Angles in degrees, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ang_normalize(x: Column) -> Column:
    """To [-180, 180]; 180 keeps the sign of x."""
    r = x % F.lit(360.0)
    return F.when(r > 180, r - 360).when(r < -180, r + 360).otherwise(r)


def ang_diff(x: Column, y: Column) -> Column:
    """y - x, in [-180, 180]."""
    return ang_normalize(ang_normalize(y) - ang_normalize(x))


def lat_fix(x: Column) -> Column:
    """x, or NaN beyond a pole."""
    return F.when(F.abs(x) <= 90, x).otherwise(F.lit(float("nan")))


def sind(x: Column) -> Column:
    """Sine, exact at multiples of 90 degrees."""
    r = ang_normalize(x)
    return F.when(F.abs(r).isin(0.0, 180.0), F.lit(0.0)).when(r == 90, F.lit(1.0)).when(r == -90, F.lit(-1.0)).otherwise(F.sin(F.radians(r)))


def cosd(x: Column) -> Column:
    """Cosine, exact at multiples of 90 degrees."""
    r = F.abs(ang_normalize(x))
    return F.when(r == 0, F.lit(1.0)).when(r == 90, F.lit(0.0)).when(r == 180, F.lit(-1.0)).otherwise(F.cos(F.radians(r)))


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def dms_parts(x: Column) -> Column:
    """Struct of whole degrees, whole minutes and seconds of |x|, and whether x is negative."""
    total = F.abs(x)
    degrees = F.floor(total)
    minutes = F.floor((total - degrees) * 60)
    return F.struct(degrees.cast("int").alias("degrees"), minutes.cast("int").alias("minutes"), (((total - degrees) * 60 - minutes) * 60).alias("seconds"), (x < 0).alias("negative"))


def dms_encode(x: Column, positive: str, negative: str) -> Column:
    """``040d38'23"N``: to the nearest second; null if x is null or not a number."""
    seconds = F.rint(F.abs(x) * 3600).cast("bigint")
    width = F.lit(2 if positive == "N" else 3)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.lpad(F.floor(seconds / 3600).cast("string"), width, F.lit("0")), F.lit("d"), two(F.floor(seconds % 3600 / 60)), F.lit("'"), two(seconds % 60), F.lit('"'), F.when(x < 0, F.lit(negative)).otherwise(F.lit(positive)))
    return F.when(~F.isnan(x), text)


def dms_decode(s: Column) -> Column:
    """Degrees of text such as ``40:38:23N``, ``-73d46'44"`` or ``33.3``; null if it is none."""
    clean = F.translate(F.upper(F.trim(s)), "°º′’″”", "DD''\"\"")
    pattern = r"^([NSEW]?)([-+]?)([0-9]+(?:\.[0-9]*)?)[D:]?(?:([0-9]+(?:\.[0-9]*)?)[':]?)?(?:([0-9]+(?:\.[0-9]*)?)\"?)?([NSEW]?)$"
    part = lambda k: F.regexp_extract(clean, pattern, k)
    number = lambda k: F.coalesce(part(k).try_cast("double"), F.lit(0.0))
    size = number(3) + (number(4) + number(5) / 60) / 60
    turned = (part(2) == "-") != (part(1).isin("S", "W") | part(6).isin("S", "W"))
    good = clean.rlike(pattern) & ((part(1) == "") | (part(6) == "")) & (number(4) < 60) & (number(5) < 60)
    return F.when(good, F.when(turned, -size).otherwise(size))
