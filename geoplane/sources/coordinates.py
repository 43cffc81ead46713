"""Lines of coordinates in any of their forms as rows, and rows as lines: military codes, two angles, or a grid zone with easting and northing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.bound import bind, struct
from ..operators import projections


def split_lines(df: DataFrame, separator: str = ";") -> DataFrame:
    """(value) of the lines in the strings (value), which ``separator`` parts as line feeds do."""
    return df.select(F.explode(F.split(F.translate("value", separator, "\n" * len(separator)), "\n")).alias("value"))


def parse_coordinates(lines: DataFrame, comment: str = "#", centre: bool = True, long_first: bool = False) -> DataFrame:
    """``lines`` (value) with comment, lat, lon, zone, north, easting, northing, error.

    One word is a military code, two are angles, three a zone with its easting and northing, in either order. Grid
    coordinates of a code or zone stay those of its zone. A line that is none has an error and nulls, in its place.
    """
    at = F.instr("value", comment)
    body = F.when(at > 0, F.substring(F.col("value"), F.lit(1), at - 1)).otherwise(F.col("value"))
    words = F.filter(F.split(F.translate(body, ",\t\r\x0b\x0c", "     "), " "), lambda x: x != "")
    rows = lines.withColumn("comment", F.when(at > 0, F.substring(F.col("value"), at, F.length("value")))).withColumn("_w", words)
    word = lambda k: F.get("_w", F.lit(k))
    first = word(0).rlike("[A-Za-z]$")
    zone = projections.decode_zone(F.when(first, word(0)).otherwise(word(2)))
    pair = [text.number_of(F.when(first, word(k + 1)).otherwise(word(k))) for k in (0, 1)]
    grid = bind(struct(z=zone, x=pair[0], y=pair[1]), lambda s: F.when(s["z"].isNotNull() & s["x"].isNotNull() & s["y"].isNotNull(), struct(zone=s["z"]["zone"], north=s["z"]["north"], easting=s["x"], northing=s["y"])))
    code = bind(projections.mgrs_reverse(word(0), centre), lambda g: F.when(g.isNotNull(), struct(zone=g["zone"], north=g["north"], easting=g["easting"], northing=g["northing"])))
    rows = rows.withColumn("_n", F.size("_w")).withColumn("_g", F.when(F.col("_n") == 1, code).when(F.col("_n") == 3, grid)).withColumn("_p", F.when(F.col("_n") == 2, text.lat_lon(word(0), word(1), long_first)))
    g = lambda c: F.col(f"_g.{c}")
    rows = rows.withColumn("_b", projections.reverse(g("zone"), g("north"), g("easting"), g("northing"))).withColumn("_f", projections.forward(F.col("_p.lat"), F.col("_p.lon")))
    angles = F.col("_n") == 2
    pick = lambda c: F.when(angles, F.col(f"_f.{c}")).otherwise(F.when(F.col("_b").isNotNull(), F.col(f"_g.{c}"))).alias(c)
    error = F.when(~F.col("_n").between(1, 3), "ERROR: one to three words are needed").when(F.when(angles, F.col("_p.lat")).otherwise(F.col("_b.lat")).isNull(), "ERROR: not a coordinate")
    place = [F.when(angles, F.col(f"_p.{c}")).otherwise(F.col(f"_b.{c}")).alias(c) for c in ("lat", "lon")]
    return rows.select(*lines.columns, "comment", *place, *map(pick, ("zone", "north", "easting", "northing")), error.alias("error"))


def read_coordinates(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_coordinates(spark.read.text(path), **options)


def stream_coordinates(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same on files that arrive in a folder."""
    return parse_coordinates(spark.readStream.text(path), **options)


def strict(rows: DataFrame) -> DataFrame:
    """The same rows; the job fails at the first that has an error."""
    return rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("error", F.lit(": "), "value")).cast("string")))


def with_comment(line: Column, comment: Column) -> Column:
    """An output line with its input's comment after it."""
    return F.when(comment.isNull(), line).otherwise(F.concat_ws(" ", line, comment))


def decimal_text(lat: Column, lon: Column, digits: int = 0, long_first: bool = False) -> Column:
    """Two numbers; digits 0 is about a metre (5 decimals)."""
    n = max(0, min(9, digits) + 5)
    a, b = (lon, lat) if long_first else (lat, lon)
    return F.concat_ws(" ", text.number_text(a, n), text.number_text(b, n))


def dms_pair(lat: Column, lon: Column, digits: int = 0, long_first: bool = False, separator: str = "") -> Column:
    """Two angles in degrees, minutes and seconds; digits 0 is about a metre (a decimal of seconds)."""
    n = max(0, min(10, digits) + 5)
    trailing, decimals = (0, n) if n < 2 else (1, n - 2) if n < 4 else (2, n - 4)
    y, x = text.dms_text(lat, trailing, decimals, "latitude", separator), text.dms_text(lon, trailing, decimals, "longitude", separator)
    return F.concat_ws(" ", *((x, y) if long_first else (y, x)))


def grid_text(zone: Column, north: Column, easting: Column, northing: Column, digits: int = 0, short: bool = True) -> Column:
    """``38n 444500 3688500`` with so many decimals; below 0, zeros stand for digits left out."""
    n = max(-5, min(9, digits))

    def one(v: Column) -> Column:
        if n >= 0:
            return text.number_text(v, n)
        cut = v / 10.0**-n
        return F.concat(text.number_text(cut, 0), F.when(F.abs(cut) > 0.5, "0" * -n).otherwise(""))

    return F.concat_ws(" ", projections.encode_zone(zone, north, short), one(easting), one(northing))


def latched_zone(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (zone, easting, northing, lat, lon) with grid coordinates in the zone of the first row by ``order`` that has one."""
    one = rows.filter(F.col("zone").isNotNull()).orderBy(*order).limit(1).select(F.col("zone").alias("_zone"))
    u = projections.forward(F.col("lat"), F.col("lon"), F.col("_zone"))
    out = rows.join(F.broadcast(one), how="left", on=F.lit(True)).withColumn("_u", u)  # a table of one row
    keep = [c for c in rows.columns if c not in ("zone", "north", "easting", "northing")]
    return out.select(*keep, *(F.col(f"_u.{c}").alias(c) for c in ("zone", "north", "easting", "northing")))
