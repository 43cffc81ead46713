"""Sums by key without rounding: values fall into bins of 32 bits, whose whole numbers Spark sums like any others."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.bound import bind, struct

#: Bits of a bin, and the highest bin of a double; smaller values than 2 ** -900 are taken 2 ** 128 times, four bins up.
BITS, TOP = 32, 31


def bins(value: Column) -> Column:
    """array<struct<bin, part>>: a finite value as the sum of whole numbers ``part`` times 2 ** (32 bin), each below 2 ** 34."""

    def scaled(s: Column) -> Column:
        tiny = F.abs(s["v"]) < 2.0**-900
        return struct(v=F.when(tiny, s["v"] * 2.0**128).otherwise(s["v"]), down=F.when(tiny, 4).otherwise(0))

    def first(s: Column) -> Column:
        top = F.when(s["v"] == 0, 0).otherwise(F.least(F.floor((F.floor(F.log2(F.abs(s["v"]))) + 1) / BITS), F.lit(TOP)))
        return struct(rest=s["v"], bin=top.cast("int"), down=s["down"], done=F.array().cast("array<struct<bin:int,part:bigint>>"))

    def next_bin(s: Column) -> Column:
        size = F.pow(F.lit(2.0), s["bin"] * BITS)
        part = (s["rest"] / size).cast("bigint")
        return struct(rest=s["rest"] - part * size, bin=s["bin"] - 1, down=s["down"], done=F.concat(s["done"], F.array(struct(bin=s["bin"] - s["down"], part=part))))

    full = bind(struct(v=value), scaled, first, next_bin, next_bin, next_bin)["done"]
    return F.filter(full, lambda p: (p["part"] != 0) | (p["bin"] == full[0]["bin"]))


#: Sums are put together in units of 2 ** -1152, below the least double.
UNITS = 1 << (BITS * 36)


def _rounded(units: int) -> float:
    try:
        return units / UNITS
    except OverflowError:
        return math.inf if units > 0 else -math.inf


def _settled(parts: pd.Series) -> pd.DataFrame:
    """The double nearest to a key's bins (70 at most) together, and what it leaves out."""
    out = []
    for own in parts:
        units = sum(int(p["total"]) << (BITS * (int(p["bin"]) + 36)) for p in own)
        high, rest = _rounded(units), 0.0
        if math.isfinite(high):
            a, b = high.as_integer_ratio()
            rest = _rounded(units - a * UNITS // b)
        out.append((high, rest))
    return pd.DataFrame(out, columns=["sum", "rest"])


def accurate_sums(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, sum, rest): the double nearest to the exact sum of each key's values, and what that leaves out.

    Nulls don't count; NaN and infinities give what they give in any sum. Whole numbers are summed in each task before
    the shuffle, so a key sends 70 rows a task at most, however many values it has, and no order of rows or loss of
    tasks changes a bit of the result.
    """
    v = F.col(value).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    parts = rows.filter(v.isNotNull()).select(F.col(key), F.when(~finite, v).alias("_odd"), F.explode(bins(F.when(finite, v).otherwise(0.0))).alias("_p"))
    by_bin = parts.groupBy(key, F.col("_p.bin").alias("bin")).agg(F.sum(F.col("_p.part").cast("decimal(20,0)")).alias("total"), F.max(F.col("_odd")).alias("_most"), F.min("_odd").alias("_least"))
    whole = by_bin.groupBy(key).agg(F.collect_list(F.struct("bin", F.col("total").cast("string").alias("total"))).alias("_parts"), F.max("_most").alias("_most"), F.min("_least").alias("_least"))
    # values that are not finite: all alike, or NaN
    odd = F.when(F.col("_most") == F.col("_least"), F.col("_most")).otherwise(F.lit(float("nan")))
    settled = whole.withColumn("_s", pandas_udf(_settled, "sum double, rest double")("_parts"))
    fine = F.col("_most").isNull()
    return settled.select(key, F.when(fine, F.col("_s.sum")).otherwise(odd).alias("sum"), F.when(fine, F.col("_s.rest")).otherwise(0.0).alias("rest"))
