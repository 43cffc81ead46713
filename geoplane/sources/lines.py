"""Text lines of coordinates as rows, in batch or as a stream: comments apart, bad lines marked in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import dms_decode


def parse_points(lines: DataFrame, comment: str = "#") -> DataFrame:
    """(value, comment, lat, lon, error) of lines (value): two angles, or letters N, S, E, W in either order."""
    at = F.instr("value", comment)
    body = F.when(at > 0, F.substring(F.col("value"), F.lit(1), at - 1)).otherwise(F.col("value"))
    fields = F.filter(F.split(F.translate(body, ",\t", "  "), " +"), lambda x: x != "")
    one, two = F.get(fields, F.lit(0)), F.get(fields, F.lit(1))
    swapped = F.upper(one).rlike("[EW]") | F.upper(two).rlike("[NS]")
    lat, lon = dms_decode(F.when(swapped, two).otherwise(one)), dms_decode(F.when(swapped, one).otherwise(two))
    error = F.when(F.size(fields) != 2, F.lit("ERROR: two fields are needed")).when(lat.isNull() | lon.isNull(), F.lit("ERROR: not an angle")).when(F.abs(lat) > 90, F.lit("ERROR: latitude is beyond a pole"))
    return lines.select("value", F.when(at > 0, F.substring(F.col("value"), at, F.length("value"))).alias("comment"), lat.alias("lat"), lon.alias("lon"), error.alias("error"))


def read_points(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    return parse_points(spark.read.text(path), comment)


def stream_points(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """The same on files that arrive in a folder."""
    return parse_points(spark.readStream.text(path), comment)
