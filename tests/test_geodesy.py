import math

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from geoplane.functions import geodesic, planes, rhumb, transverse
from geoplane.functions.ellipsoid import WGS84
from geoplane.operators import geodesics, neighbours, polygons, projections
from geoplane.plans import queries
from geoplane.sources.lines import parse_points, stream_points

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for table in ("customer", "orders"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    nulls_last = lambda r: [(x is None, 0 if x is None else x) for x in r]
    rows, other = (sorted(map(tuple, x), key=nulls_last) for x in (got.select(*columns).collect(), want.select(*columns).fetchall()))
    assert len(rows) == len(other)
    for a, b in zip(rows, other):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_known_geodesics():
    g = geodesic.inverse(40 + 38 / 60 + 23 / 3600, -(73 + 46 / 60 + 44 / 3600), 1 + 21 / 60 + 33 / 3600, 103 + 59 / 60 + 22 / 3600)
    assert g["s12"][0] == pytest.approx(15347628, abs=1) and g["azi1"][0] == pytest.approx(3 + 18 / 60 + 29.9 / 3600, abs=2e-5)
    r = rhumb.rhumb_inverse(40 + 38 / 60 + 23 / 3600, -(73 + 46 / 60 + 44 / 3600), 1 + 21 / 60 + 33 / 3600, 103 + 59 / 60 + 22 / 3600)
    assert r["s12"][0] == pytest.approx(18523563, abs=1) and r["azi12"][0] == pytest.approx(103 + 34 / 60 + 58.2 / 3600, abs=2e-5)


def test_direct_and_inverse_agree():
    rng = np.random.default_rng(0)
    n = 3000
    lat, lon, azi, s = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), rng.uniform(-180, 180, n), rng.uniform(0, 1.99e7, n)
    d = geodesic.direct(lat, lon, azi, s)
    assert np.abs(geodesic.inverse(lat, lon, d["lat2"], d["lon2"])["s12"] - s).max() < 1e-6
    r = rhumb.rhumb_direct(lat, lon, azi, s / 10)
    ok = np.isfinite(r["lat2"]) & (np.abs(r["lat2"]) < 70) & (np.abs(lat) < 70)
    back = rhumb.rhumb_inverse(lat[ok], lon[ok], r["lat2"][ok], r["lon2"][ok])
    assert np.abs(back["s12"] - s[ok] / 10).max() < 1e-2


def test_nothing_in_gives_nan():
    g = geodesic.inverse([np.nan, 91.0, 0.0], [0, 0, 0], [0, 0, 0], [1, 1, 0])
    assert np.isnan(g["s12"][:2]).all() and g["s12"][2] == 0


def test_polygons(spark):
    r = 18454562325.45119
    rings = {
        "triangle": [(0.1, 0.0), (0.0, 0.1), (0.1, 0.1)],
        "octant": [(0, 0), (0, 90), (90, 0)],
        "pole": [(45.0, 40.0 * k) for k in range(9)],
        "pole south": [(-45.0, -40.0 * k) for k in range(9)],
        "two": [(1.0, 1.0), (2.0, 2.0)],
        "one": [(1.0, 1.0)],
    }
    rows = [(k, i, float(a), float(b)) for k, v in rings.items() for i, (a, b) in enumerate(v)]
    df = spark.createDataFrame(rows, "ring string, seq int, lat double, lon double")
    got = {x.ring: x for x in polygons.polygon_areas(df, "ring", ["seq"]).collect()}
    assert abs(got["octant"].area) == pytest.approx(WGS84.area / 8, rel=1e-9)
    assert got["two"].area == got["one"].area == got["one"].perimeter == 0 and got["two"].perimeter > 3e5
    assert got["pole"].area == pytest.approx(9 * got["pole"].area / 9) and 0 < got["pole"].area < WGS84.area / 4
    assert got["pole south"].area == pytest.approx(got["pole"].area, rel=1e-9)
    assert 0 < abs(got["triangle"].area) < r


def test_joins_are_brute_force(spark):
    a, b = queries._customers(spark, SF), queries.points(spark, SF, "supplier", "s_suppkey").withColumnRenamed("id", "s_id")
    x, y = a.toPandas(), b.toPandas()
    d = {(i, j): geodesic.inverse(la, lo, y.lat.to_numpy(), y.lon.to_numpy())["s12"][n] for i, la, lo in x.itertuples(index=False) for n, j in enumerate(y.s_id)}
    got = {(r.id, r.s_id) for r in neighbours.radius_join(a, b, "id", "s_id", 2_000_000.0).collect()}
    assert got == {k for k, v in d.items() if v <= 2_000_000}
    near = {(r.id, r["rank"]): r.s_id for r in neighbours.nearest_join(a, b, "id", "s_id", 2).collect()}
    want = {(i, k + 1): j for i in x.id for k, j in enumerate(sorted(y.s_id, key=lambda j: (d[i, j], j))[:2])}
    assert near == want


def test_nearest_with_limits(spark):
    a = queries._customers(spark, SF)
    x = a.toPandas()
    d = {(i, j): geodesic.inverse(la, lo, x.lat.to_numpy(), x.lon.to_numpy())["s12"][n] for i, la, lo in x.itertuples(index=False) for n, j in enumerate(x.id)}
    b = a.withColumnRenamed("id", "other")
    near = {(r.id, r["rank"]): r.other for r in neighbours.nearest_join(a, b, "id", "other", 2, least=0.0, most=1_500_000.0).collect()}
    want = {(i, k + 1): j for i in x.id for k, j in enumerate([j for j in sorted(x.id, key=lambda j: (d[i, j], j)) if 0 < d[i, j] <= 1_500_000][:2])}
    assert near == want
    got = {r.id for r in neighbours.within_radius(a, b.filter("other % 7 = 0"), "id", "other", 800_000.0).collect()}
    assert got == {i for i in x.id if any(d[i, j] <= 800_000 for j in x.id if j % 7 == 0)}


def test_lines(spark, tmp_path):
    lines = ["40:38:23N 073:46:44W # home", "33.3 44.4", "E44d24 N33d20", "91 0", "x y", "1", ""]
    got = parse_points(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert got[0].lat == pytest.approx(40.63972222) and got[0].lon == pytest.approx(-73.77888889) and got[0].comment == "# home"
    assert (got[1].lat, got[1].lon) == (33.3, 44.4) and got[2].lat == pytest.approx(33 + 1 / 3) and got[2].lon == pytest.approx(44.4)
    assert [bool(r.error) for r in got] == [False, False, False, True, True, True, True]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines[:3]))
    query = stream_points(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("streamed").count() == 3


def test_planes(spark):
    df = spark.createDataFrame([(39.95, -75.17), (90.0, 20.0), (-90.0, 20.0), (-60.0, 100.0), (84.5, -170.0), (None, 1.0)], "lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    u, m = planes.polar_stereographic(lat >= 0, lat, lon), planes.mercator(lat, lon)
    back = planes.polar_stereographic_reverse(lat >= 0, F.col("u.x"), F.col("u.y"))
    got = df.withColumn("u", u).withColumn("m", m).select("*", planes.lambert_conformal(lat, lon, 40 + 58 / 60, 39 + 56 / 60, -77.75).alias("c"), back.alias("b"), planes.mercator_reverse(F.col("m.x"), F.col("m.y")).alias("w")).collect()
    c = got[0].c
    assert (round(c.x), round(c.y), round(c.gamma, 2), round(c.k, 1)) == (220445, -52372, 1.67, 1.0)
    for r in got[:5]:
        assert r.b.lat == pytest.approx(r.lat, abs=1e-8)
        assert abs(r.lat) == 90 or r.b.lon == pytest.approx(r.lon, abs=1e-9)
        assert r.m is None if abs(r.lat) == 90 else (r.w.lat, r.w.lon) == pytest.approx((r.lat, r.lon), abs=1e-9)
    assert got[1].u.x == 0 and got[1].u.k == 0.994 and got[2].c is None and got[1].c.k is None


def test_mgrs(spark):
    df = spark.createDataFrame([(33.33424, 44.40363), (33 + 1 / 3, 44.4), (0.0, 3.0), (85.0, 0.0), (None, 0.0)], "lat double, lon double")
    assert [r[0] for r in df.select(projections.mgrs(F.col("lat"), F.col("lon"), 2)).collect()] == ["38SMB4488", "38SMB4488", "31NEA0000", "ZAB0044", None]


def test_half_a_turn_is_written_as_in_sql(spark, tmp_path):
    """Key 9815 has the angle -540."""
    duckdb.sql(f"copy (select unnest([9815, 1, 2])::bigint as c_custkey) to '{tmp_path}/customer.parquet' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    got = sorted(map(tuple, queries.angle_normalize(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(queries.ORACLE_SQL["angle_normalize"]).fetchall()) and got[-1][1] == 180.0


def test_keys_are_dealt_by_their_number(spark, tmp_path):
    """A million keys take a few megabytes, so one split of a file, but many seconds of a kernel."""
    n = 3 * queries.ROWS_A_TASK
    spark.range(1, n + 1, 1, 1).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    each = [r["count"] for r in queries.points(spark, str(tmp_path), "customer", "c_custkey").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == n and max(each) < 1.1 * queries.ROWS_A_TASK
