"""Texts of numbers, dates, angles and coordinates, with published pairs."""

import math

import pytest
from pyspark.sql import functions as F

from geoplane.functions import text as t
from geoplane.sources import coordinates as c


def each(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").coalesce(1).select(f(F.col("x")).alias("y")).collect()]


def test_numbers(spark):
    # Published pairs of numbers and texts.
    for digits, pairs in ((0, {-3.5: "-4", -2.5: "-2", -0.5: "-0", -0.0: "-0", 0.5: "0", 1.5: "2", 2.5: "2", 3.5: "4", math.inf: "inf", -math.inf: "-inf", 1e21: "1" + "0" * 21}), (1, {-1.75: "-1.8", -1.25: "-1.2", -0.25: "-0.2", 0.25: "0.2", 0.75: "0.8", 1.75: "1.8"})):
        assert each(spark, lambda x: t.number_text(x, digits), list(pairs), "double") == list(pairs.values())
    assert each(spark, lambda x: t.number_text(x, 0), [math.nan, None], "double") == ["nan", None]
    got = each(spark, t.number_of, ["+0", "-0", "+inf", "-inf", "1e3", " .5 ", "1.5x", "", "nan"])
    assert got[:6] == [0, 0, math.inf, -math.inf, 1000, 0.5] and math.copysign(1, got[1]) == -1 and got[6:8] == [None, None] and math.isnan(got[8])
    assert each(spark, t.fraction_of, ["1/298.25", "3", "1/0", "a/b"]) == [1 / 298.25, 3, None, None]


def test_dates(spark):
    df = spark.createDataFrame([(1, 1, 1), (1752, 9, 2), (1752, 9, 14), (2000, 2, 29), (1900, 2, 29), (2024, 12, 31), (1752, 9, 5), (1700, 2, 29), (2024, 13, 1)], "y int, m int, d int")
    rows = df.coalesce(1).withColumn("n", t.day_number(F.col("y"), F.col("m"), F.col("d"))).withColumn("w", t.weekday(F.col("n"))).collect()
    assert [r.n for r in rows] == [1, 639798, 639799, 730181, None, 739253, None, 620619, None]
    assert rows[0].w == 6 and rows[3].w == 2 and rows[5].w == 2
    got = each(spark, t.fractional_year, ["2010", "2010.25", "2010-07-02", "2012-01-01", "2010-13", "x"])
    assert got == [2010, 2010.25, pytest.approx(2010 + 182 / 365), 2012, None, None]


ANGLE = -(1 + 2 / 60 + 2.99 / 3600)
FORMS = [  # Fixed values: trailing unit, digits, kind, text
    (0, 0, "none", "-1"), (0, 0, "latitude", "01S"), (0, 0, "longitude", "001W"), (0, 0, "azimuth", "001"), (0, 1, "none", "-1.0"), (0, 1, "latitude", "01.0S"),
    (0, 1, "azimuth", "001.0"), (1, 0, "none", "-1d02'"), (1, 0, "latitude", "01d02'S"), (1, 0, "azimuth", "001d02'"), (1, 1, "longitude", "001d02.0'W"),
    (2, 0, "none", "-1d02'03\""), (2, 0, "latitude", "01d02'03\"S"), (2, 0, "azimuth", "001d02'03\""), (2, 1, "none", "-1d02'03.0\""), (2, 1, "longitude", "001d02'03.0\"W"),
]


def test_angles_as_text(spark):
    df = spark.createDataFrame([(ANGLE,)], "x double")
    got = df.select(*(t.dms_text(-F.col("x") if k == "azimuth" else F.col("x"), u, n, k).alias(f"c{i}") for i, (u, n, k, _) in enumerate(FORMS))).first()
    assert list(got) == [f[3] for f in FORMS]
    assert each(spark, lambda x: t.dms_text(x, 2, 0, "latitude", ":"), [40.63972222, 59.99999999], "double") == ["40:38:23N", "60:00:00N"]


def test_angles_from_text(spark):
    good = {"40d38'23\"N": 40 + 38 / 60 + 23 / 3600, "40:38:23": 40 + 38 / 60 + 23 / 3600, "20:30+1:30": 22.0, "-73.5": -73.5, "W5d30": -5.5, "30'": 0.5, "4d30\"": 4 + 30 / 3600, "40°38′23″": 40 + 38 / 60 + 23 / 3600, "-0S": 0.0, "+0S": -0.0, "10+5-1": 14.0, "N-5": -5.0}
    got = each(spark, lambda x: t.dms_value(x)["value"], list(good))
    assert got == [pytest.approx(v, abs=1e-14) for v in good.values()] and math.copysign(1, got[9]) == -1 and math.copysign(1, got[8]) == 1
    bad = each(spark, lambda x: t.dms_value(x)["value"], ["", "N", "40d60'", "4.5d30", "40:", "N5S", "5d5d", "x", "1:2:3:4", "5'4d", "3N+4E", None])
    assert bad == [None] * 12
    special = each(spark, lambda x: t.dms_value(x)["value"], [" nan", "+inf", "-inf"])
    assert math.isnan(special[0]) and special[1:] == [math.inf, -math.inf]
    assert each(spark, t.arc_angle, ["10", "10N"]) == [10, None] and each(spark, t.azimuth, ["270", "10E", "10N"]) == [-90, 10, None]


def test_coordinates(spark):
    lines = ["38SMB4488 # home", "33.33424 44.40363", "E44d24 N33d20", "38n 444500 3688500", "444500 3688500 38n", "20S 30S", "91 0", "1 2 3 4", "", "38SMX44", "0n 1 2"]
    rows = c.parse_coordinates(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).withColumn("utm", c.grid_text(F.col("zone"), F.col("north"), F.col("easting"), F.col("northing")))
    rows = rows.withColumn("geo", c.decimal_text(F.col("lat"), F.col("lon"))).withColumn("dms", c.dms_pair(F.col("lat"), F.col("lon"), -1)).withColumn("line", c.with_comment(F.col("geo"), F.col("comment"))).withColumn("cut", c.grid_text(F.col("zone"), F.col("north"), F.col("easting"), F.col("northing"), -3))
    got = rows.collect()
    assert got[0].geo == "33.33424 44.40363" and got[0].utm == "38n 444500 3688500" and got[0].line == "33.33424 44.40363 # home" and got[0].cut == "38n 444000 3688000"
    assert got[3].geo == got[4].geo == got[0].geo and got[2].lat == pytest.approx(33 + 1 / 3) and got[2].dms == "33d20'00\"N 044d24'00\"E"
    assert got[1].zone == 38 and [bool(r.error) for r in got] == [False] * 5 + [True] * 6
    with pytest.raises(Exception, match="not a coordinate"):
        c.strict(c.parse_coordinates(spark.createDataFrame([("x y",)], "value string"))).collect()
    assert c.split_lines(spark.createDataFrame([("1 2;3 4\n5 6",)], "value string")).count() == 3
    latched = c.latched_zone(c.parse_coordinates(spark.createDataFrame([("40 5.9",), ("40 6.1",)], "value string")), ["value"]).orderBy("value").collect()
    assert [r.zone for r in latched] == [31, 31] and latched[1].easting > 7e5
