"""Grid codes and grid coordinates: published pairs, and back and forth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoplane.functions import grids
from geoplane.operators import osgb, projections as p


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    global LAT, LON
    LAT, LON = F.col("lat"), F.col("lon")


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400))]
    rows += [(60.0, 3.5), (75.0, 8.0), (75.0, 20.0), (84.0, 5.0), (-80.0, 5.0), (90.0, 0.0), (-90.0, 7.0), (0.0, 180.0), (63.999, 2.999)]
    frame = spark.createDataFrame(rows, "lat double, lon double").cache()
    yield frame
    frame.unpersist()


def first(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_grid_coordinates_come_back(world):
    out = world.withColumn("u", p.forward(LAT, LON)).withColumn("b", p.reverse(F.col("u.zone"), F.col("u.north"), F.col("u.easting"), F.col("u.northing"))).collect()
    for r in out:
        assert r.b.lat == pytest.approx(r.lat, abs=1e-9)
        assert abs(r.lat) == 90 or abs((r.b.lon - r.lon + 180) % 360 - 180) * np.cos(np.radians(r.lat)) < 1e-9
        assert r.b.k == pytest.approx(r.u.k, abs=1e-9) and (r.u.zone == 0) == (r.lat < -80 or r.lat >= 84)
    zones = {(r.lat, r.lon): r.u.zone for r in out}
    assert (zones[60.0, 3.5], zones[75.0, 8.0], zones[75.0, 20.0]) == (32, 31, 33)


def test_signed_equator_and_limits(spark):
    df = spark.createDataFrame([(0.0, 3.0), (-0.0, 3.0), (10.0, 80.0), (None, 1.0), (float("nan"), 1.0), (91.0, 1.0)], "lat double, lon double")
    got = df.select(p.forward(LAT, LON).alias("u"), p.mgrs(LAT, LON, 2).alias("m"), p.forward(LAT, LON, F.lit(31)).alias("far")).collect()
    assert [(r.u.northing, r.u.north, r.m) for r in got[:2]] == [(0.0, True, "31NEA0000"), (10e6, False, "31MEV0099")]
    assert got[2].far is None and got[2].u.zone == 44 and [r.u for r in got[3:]] == [None] * 3


@pytest.mark.parametrize("digits", [0, 2, 5, 8])
def test_codes_come_back(world, digits):
    m = world.withColumn("m", p.mgrs(LAT, LON, digits)).withColumn("g", p.mgrs_reverse(F.col("m")))
    m = m.withColumn("u", p.forward(LAT, LON)).collect()
    half = 1e5 / 10**digits / 2
    for r in m:
        assert r.g.digits == digits and r.g.zone == r.u.zone and r.g.north == r.u.north, r
        assert abs(r.g.easting - r.u.easting) <= half + 1e-5 and abs(r.g.northing - r.u.northing) <= half + 1e-5


def test_published_codes(spark):
    df = spark.createDataFrame([(33.33424, 44.40363), (33 + 1 / 3, 44.4), (85.0, 0.0), (-85.0, -90.0)], "lat double, lon double")
    got = [r[0] for r in df.select(p.mgrs(LAT, LON, 2)).collect()]
    assert got[:2] == ["38SMB4488"] * 2 and got[2][0] in "YZ" and got[3][0] == "A"
    g = first(spark, p.mgrs_reverse, "38SMB4488", "38smb", "38S", "31V", "38SMB448", "99SMB", "38SIB", "38SMX44", "Z", "hello", "", "0ZAH")
    assert (g[0].zone, g[0].north, g[0].easting, g[0].northing) == (38, True, 444500.0, 3688500.0)
    assert g[1].digits == 0 and g[2].digits == g[3].digits == g[8].digits == -1 and g[3].easting == 400000
    assert g[4:8] == [None] * 4 and g[9:] == [None] * 3
    parts = first(spark, p.mgrs_parts, "38SMB4488", "38S", "ZAH", "38SM", "38SMB448")
    assert tuple(parts[0]) == ("38S", "MB", "44", "88") and tuple(parts[1]) == ("38S", "", "", "") and tuple(parts[2]) == ("Z", "AH", "", "") and parts[3:] == [None, None]


def test_rows_of_bands():
    """The 16 tiles that lie across a band's edge on some columns only are known; all else is whole rows."""
    low, high = (np.array(x).reshape(20, 8) for x in p._rows_of_bands())
    assert (low[19, 3:5].tolist(), low[18, 3].tolist(), high[18].tolist()[:4], high[17].tolist()[:4]) == ([79, 79], 70, [80, 80, 79, 79], [71, 71, 71, 70])
    assert (low[10] == 0).all() and (high[9] == -1).all() and (high[19] == 94).all() and (low[0] == -90).all()


def test_zones(spark):
    z = first(spark, p.decode_zone, "38n", "09South", "s", "NORTH", "0n", "61n", "38", "n38", "")
    assert [tuple(x) if x else None for x in z] == [(38, True), (9, False), (0, False), (0, True), None, None, None, None, None]
    df = spark.createDataFrame([(38, True), (9, False), (0, False), (61, True)], "z int, n boolean")
    assert [tuple(r) for r in df.select(p.encode_zone(F.col("z"), F.col("n")), p.encode_zone(F.col("z"), F.col("n"), False)).collect()] == [("38n", "38north"), ("09s", "09south"), ("s", "south"), (None, None)]
    codes = spark.createDataFrame([(32638,), (32709,), (32661,), (32761,), (4326,)], "c int").select(p.decode_epsg(F.col("c")))
    assert [tuple(r[0]) if r[0] else None for r in codes.collect()] == [(38, True), (9, False), (0, True), (0, False), None]


def test_transfer(spark):
    df = spark.createDataFrame([(44.4, 5.9), (-1.0, 6.1)], "lat double, lon double").withColumn("u", p.forward(LAT, LON))
    t = p.transfer(F.col("u.zone"), F.col("u.north"), F.col("u.easting"), F.col("u.northing"), F.lit(32), F.lit(False))
    for r in df.withColumn("t", t).withColumn("d", p.forward(LAT, LON, F.lit(32))).collect():
        assert r.t.zone == 32 and not r.t.north and r.t.easting == pytest.approx(r.d.easting, abs=1e-6)
        assert r.t.northing == pytest.approx(r.d.northing + (10e6 if r.d.north else 0), abs=1e-6)


def test_britain(spark):
    df = spark.createDataFrame([(52.65757030139, 1.717921580645)], "lat double, lon double").withColumn("g", osgb.forward(LAT, LON))
    r = df.select("g", osgb.grid_reference(F.col("g.easting"), F.col("g.northing"), 3).alias("t"), osgb.reverse(F.col("g.easting"), F.col("g.northing")).alias("b")).first()
    assert (r.g.easting, r.g.northing) == pytest.approx((651409.903, 313177.270), abs=2e-3) and r.t == "TG514131"
    assert (r.b.lat, r.b.lon) == pytest.approx((52.65757030139, 1.717921580645), abs=1e-9)
    g = first(spark, osgb.grid_reference_reverse, "TG 514 131", "SV", "tg5", "II11", "TG514131x")
    assert tuple(g[0]) == (651450.0, 313150.0, 3) and tuple(g[1]) == (50000.0, 50000.0, 0) and g[2:] == [None] * 3


def test_cells_come_back(world):
    codes = {f"g{k}": grids.gars_reverse(grids.gars(LAT, LON, k)) for k in range(3)} | {f"r{k}": grids.georef_reverse(grids.georef(LAT, LON, k)) for k in (0, 1, 2, 5)}
    codes |= {f"h{k}": grids.geohash_cell(grids.geohash(LAT, LON, k)) for k in (1, 7, 12, 13, 18)}
    rows = world.filter("lat < 90").orderBy("lat", "lon")
    columns = {c: [r[0] for r in rows.select(code).collect()] for c, code in codes.items()}  # one at a time: all together make a plan of many megabytes
    out = [dict(zip(("lat", "lon", *columns), row)) for row in zip(*zip(*rows.select("lat", "lon").collect()), *columns.values())]
    apart = lambda a, b: abs((a - b + 180) % 360 - 180)
    for r in out:
        lat, lon = r["lat"], r["lon"]
        for cells, size in ((("g0", "g1", "g2"), grids.gars_resolution), (("r0", "r1", "r2", "r5"), grids.georef_resolution)):
            for c in cells:
                assert r[c].precision == int(c[1:])
                assert abs(r[c].lat - lat) <= size(int(c[1:])) / 2 + 1e-9 and apart(r[c].lon, lon) <= size(int(c[1:])) / 2 + 1e-9
        for c in ("h1", "h7", "h12", "h13", "h18"):
            y, x = grids.geohash_resolution(int(c[1:]))
            assert abs(r[c].lat - lat) <= y / 2 * 1.0001 + 2e-14 and apart(r[c].lon, lon) <= x / 2 * 1.0001 + 4e-14


def test_precisions():
    assert grids.geohash_length(0.01) == 7 and grids.geohash_resolution(2) == (180 / 32, 360 / 32) and grids.geohash_digits(12) == 6
    assert grids.gars_precision(0.3) == 1 and grids.gars_precision(1e-9) == 2 and grids.georef_precision(0.02) == 2 and grids.georef_precision(20) == 0


def test_known_geohash(spark):
    df = spark.createDataFrame([(57.64911, 10.40744)], "lat double, lon double")
    assert df.select(grids.geohash(LAT, LON, 11)).first()[0] == "u4pruydqqvj"
    bad = first(spark, grids.gars_reverse, "006AG39", "000AG", "721AG", "006IG", "x") + first(spark, grids.georef_reverse, "GJPJ0000", "GJPJ6000", "GJPJ12", "GJ", "GZ")
    assert bad[0].precision == 2 and bad[1:5] == [None] * 4 and bad[5].precision == 2 and bad[6:8] == [None] * 2 and bad[8].precision == 0 and bad[9] is None
