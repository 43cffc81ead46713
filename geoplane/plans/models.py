"""Registered queries of fields, grids, exact sums and searches with a tolerance, and their SQL. Points, coefficients and grids are made from the numbers of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames, grids, series, turns
from ..functions.raster import CELLS, INNER, NORTH, SOUTH, TERMS, cubic
from ..functions.triaxial import Triaxial
from ..operators import centred, fields, neighbours, raster, shapes, sums
from ..operators.series import fitted, period_inverse
from ..operators.staging import staged
from .queries import _r

DEGREE, ROWS, COLUMNS = 20, 19, 36


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")


def harmonic_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of harmonics at points on circles of latitude."""
    k = F.col("doc_id")
    n, part = k % (DEGREE + 1), lambda c: (F.sum(c) % 1000) / 1000.0 - 0.5
    table = _documents(spark, sf_dir).groupBy(n.alias("n"), (F.floor(k / (DEGREE + 1)) % (n + 1)).alias("m")).agg(part("n_chars").alias("c"), part("doc_id").alias("s"))
    points = _documents(spark, sf_dir).select(
        k.alias("id"), ((k * 7919) % 181 - 90).cast("double").alias("lat"), (((k * 104729) % 36000).cast("double") / 100.0 - 180.0).alias("lon"), (1 + (k % 3) / 100.0).alias("r")
    )
    g = fields.harmonic(fields.coefficients(table), 1.0, F.col("lat"), F.col("lon"), F.col("r"))
    return fields.by_circles(points, h="r").withColumn("g", g).select("id", *(_r(F.col(f"g.{c}"), c) for c in ("v", "up", "north", "east")))


def _circles_sql() -> str:
    turn = lambda a, b: f"({a} * cos(radians(m * lon)) + {b} * sin(radians(m * lon)))"
    return f"""with recursive k as (select doc_id % {DEGREE + 1} as n, doc_id // {DEGREE + 1} % (doc_id % {DEGREE + 1} + 1) as m, (sum(n_chars) % 1000) / 1000.0 - 0.5 as c, (sum(doc_id) % 1000) / 1000.0 - 0.5 as s from documents group by 1, 2),
p as (select doc_id as id, cast((doc_id * 7919) % 181 - 90 as double) as lat, cast((doc_id * 104729) % 36000 as double) / 100.0 - 180.0 as lon, 1 + (doc_id % 3) / 100.0 as r from documents),
diagonal as (select 0 as m, cast(1 as double) as d union all select m + 1, d * sqrt(case when m = 0 then 3.0 else (2.0 * m + 3) / (2 * m + 2) end) from diagonal where m < {DEGREE}),
circle as (select distinct lat, r, sin(radians(lat)) as t, case when abs(lat) = 90 then 0 else cos(radians(lat)) end as u, 1 / r as q from p),
legendre as (select lat, r, t, u, q, m, m as n, d * pow(q, m + 1) as p1, cast(0 as double) as p0, cast(0 as double) as d1, cast(0 as double) as d0 from circle, diagonal
 union all select lat, r, t, u, q, m, n + 1, a * t * p1 - b * p0, p1, a * (p1 + t * d1) - b * d0, d1 from (select *, sqrt((2.0 * n + 1) * (2 * n + 3) / ((n + 1.0 - m) * (n + 1 + m))) * q as a,
  case when n = m then 0 else sqrt((2.0 * n + 3) * (n + m) * (n - m) / ((n + 1.0 - m) * (n + 1 + m) * (2 * n - 1))) * q * q end as b from legendre) where n < {DEGREE}),
e as (select id, n, m, c, case when m = 0 then 0 else s end as s, lon, l.* exclude (n, m, lat, r), l.r from p join legendre l on p.lat = l.lat and p.r = l.r join k using (n, m))
select id, round(sum({turn('c', 's')} * pow(u, m) * p1), 6) as v, round(sum(-(n + 1) * {turn('c', 's')} * pow(u, m) * p1 / r), 6) as up,
round(-sum({turn('c', 's')} * (m * t * pow(u, greatest(m - 1, 0)) * p1 - pow(u, m + 1) * d1) / r), 6) as north, round(sum(m * {turn('s', '-c')} * pow(u, greatest(m - 1, 0)) * p1 / r), 6) as east from e group by id"""


def raster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights between the cells of a grid of documents, bilinear and cubic, at points up to both poles."""
    k, docs = F.col("doc_id"), _documents(spark, sf_dir)
    grid = raster.raster_of(docs, ROWS, COLUMNS, k % ROWS, F.floor(k / ROWS) % COLUMNS, (F.col("n_chars") % 100).cast("double"))
    points = docs.select(k.alias("id"), ((k * 7919) % 18001 / 100.0 - 90).alias("lat"), ((k * 104729) % 36000 / 100.0 - 180).alias("lon"))
    table = raster.tiles(grid)
    both = raster.raster_heights(raster.raster_heights(points, grid, table=table, name="smooth"), grid, smooth=False, table=table, name="plain")
    return both.select("id", _r(F.col("smooth"), "smooth"), _r(F.col("plain"), "plain"))


def _raster_sql() -> str:
    def weight(kind: int, cell: int) -> str:
        y = "(1 - fy)" if kind == SOUTH else "fy"
        return " + ".join(f"{float(f)!r} * pow(fx, {i}) * pow({y}, {j})" for f, (i, j) in zip(cubic(kind)[:, cell], TERMS) if abs(f) > 1e-12)

    weights = ", ".join(f"({r}, {c}, {k})" for k, (r, c) in enumerate(CELLS))
    smooth = " ".join(f"when {k} then case when iy = 0 then {weight(NORTH, k)} when iy = {ROWS - 2} then {weight(SOUTH, k)} else {weight(INNER, k)} end" for k in range(len(CELLS)))
    plain = "case when dr in (0, 1) and dc in (0, 1) then (case when dr = 0 then 1 - fy else fy end) * (case when dc = 0 then 1 - fx else fx end) else 0 end"
    return f"""with g as (select doc_id % {ROWS} as r, doc_id // {ROWS} % {COLUMNS} as c, sum(n_chars % 100) as v from documents group by 1, 2),
p as (select doc_id as id, (90 - ((doc_id * 7919) % 18001 / 100.0 - 90)) * ({ROWS - 1} / 180.0) as y, ((doc_id * 104729) % 36000 / 100.0 + 180) % 360 * ({COLUMNS} / 360.0) as x from documents),
q as (select id, least(cast(floor(y) as int), {ROWS - 2}) as iy, cast(floor(x) as int) as ix, x - floor(x) as fx, y - least(floor(y), {ROWS - 2}) as fy from p),
w(dr, dc, k) as (values {weights}),
s as (select id, iy, fx, fy, dr, dc, k, case when iy + dr < 0 then -(iy + dr) when iy + dr > {ROWS - 1} then {2 * ROWS - 2} - (iy + dr) else iy + dr end as r,
 (ix + dc + {COLUMNS} + case when iy + dr < 0 or iy + dr > {ROWS - 1} then {COLUMNS // 2} else 0 end) % {COLUMNS} as c from q, w)
select id, round(sum(coalesce(v, 0) * (case k {smooth} end)), 6) as smooth, round(sum(coalesce(v, 0) * {plain}), 6) as plain from s left join g using (r, c) group by id"""


def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums by tens of documents, a third of them under one key, of values whose sums as doubles would depend on their order."""
    n, k = F.col("n_chars").cast("double"), F.col("doc_id")
    value = F.when(k % 2 == 0, n * 1e15).otherwise(-n / 3)
    docs = _documents(spark, sf_dir).select(F.when(k % 3 == 0, -1).otherwise(F.floor(k / 10)).cast("bigint").alias("ten"), value.alias("v"))
    return sums.accurate_sums(docs, "ten", "v").select("ten", "sum", "rest")


def tolerant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a point of each document three others, none over 5 km farther than the nearest ones are."""
    points = _points(spark, sf_dir)
    found = neighbours.nearest_join(points, points.withColumnRenamed("id", "other"), "id", "other", 3, least=0.0, tolerance=5000.0)
    return found.select("id", "other", "rank", _r(F.col("distance"), "distance", 3))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return _documents(spark, sf_dir).select(k.alias("id"), ((k * 7919) % 17001 / 100.0 - 85).alias("lat"), ((k * 104729) % 36000 / 100.0 - 180).alias("lon"))


PTS = "p as (select doc_id as id, (doc_id * 7919) % 17001 / 100.0 - 85 as lat, (doc_id * 104729) % 36000 / 100.0 - 180 as lon from documents)"


def exact_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transverse Mercator projection of points all over the ellipsoid, and back."""
    rows = _points(spark, sf_dir).withColumn("g", centred.transverse_mercator_exact(F.lit(0.0), F.col("lat"), F.col("lon")))
    rows = staged(rows, "mercator").withColumn("b", centred.transverse_mercator_exact_reverse(F.lit(0.0), F.col("g.x"), F.col("g.y")))
    return rows.select("id", (F.col("g.x") >= 0).alias("east"), (F.col("g.k") >= 1 - 1e-12).alias("wide"), _r(F.col("b.lat"), "lat2", 7), _r(F.abs("b.lon"), "lon2", 7))


def local_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a frame about Paris, and back."""
    at = (48.85, 2.35, 100.0)
    rows = _points(spark, sf_dir).withColumn("g", frames.local_cartesian(F.col("lat"), F.col("lon"), F.col("lat") * 10, *at))
    b = frames.local_cartesian_reverse(F.col("g.east"), F.col("g.north"), F.col("g.up"), *at)
    return rows.withColumn("b", b).select("id", _r(F.col("b.lat"), "lat2", 7), _r(F.abs("b.lon"), "lon2", 7), _r(F.col("b.h"), "h2", 3))


def geohash_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geohashes of 15 and 18 characters, and the centres of their cells."""
    lat, lon = F.col("lat") + F.col("id") / 1e9, F.col("lon") + F.col("id") / 1e10
    rows = _points(spark, sf_dir).select("id", grids.geohash(lat, lon, 18).alias("code"), grids.geohash(lat, lon, 15).alias("short"))
    cell = rows.withColumn("c", grids.geohash_cell(F.col("code"))).withColumn("s", grids.geohash_cell(F.col("short")))
    return cell.select("id", F.col("code").startswith(F.col("short")).alias("within"), *(_r(F.col(f"{c}.{x}"), f"{x}_{c}", 9) for c in "cs" for x in ("lat", "lon")))


def angle_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of angles of many turns, and what turns, quadrants and right angles there are in them."""
    k = F.col("doc_id")
    a, b = ((k * 7919) % 36001 - 18000) / 10 + 0.03, ((k * 104729) % 14401 - 7200) / 10 + 0.04
    rows = _documents(spark, sf_dir).select(k.alias("id"), a.alias("a"), b.alias("b"), turns.turn(a).alias("x"), turns.turn(b).alias("y"))
    rows = rows.withColumn("z", turns.plus(F.col("x"), F.col("y"))).withColumn("w", turns.rebase(F.col("z"), F.col("x")))
    z, whole = F.col("z"), lambda c, n: c.cast("bigint").alias(n)
    return rows.select(
        "id", _r(turns.degrees(z), "total", 7), _r(turns.degrees(turns.base(z)), "base", 7), whole(z["n"], "whole"), whole(turns.quadrant(z), "quadrant"), whole(turns.quarters(z), "quarters"),
        _r(turns.degrees(F.col("w")), "near", 7), (F.round(turns.degrees(turns.nearest(z)), 7) + 0.0).alias("cardinal"), turns.lat_lon_text(turns.turn(F.lit(0.5)), turns.base(turns.turn(F.lit(360.25))), 0).alias("text"),
    )


def triaxial_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest lines on a triaxial Earth between two points of each document."""
    k = F.col("id")
    other = ((k * 7907) % 17001 / 100.0 - 85, (k * 104723) % 36000 / 100.0 - 180)
    g = shapes.triaxial_inverse(Triaxial(), F.col("lat"), F.col("lon"), *other, "s12 azi1 azi2 m12")
    return _points(spark, sf_dir).withColumn("g", g).select("id", _r(F.col("g.s12"), "s12", 3), _r(F.col("g.azi1"), "azi1", 6), _r(F.col("g.azi2"), "azi2", 6), _r(F.col("g.m12"), "m12", 3))


def triaxial_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of up to 20,000 km on a triaxial Earth, and back from their ends; Liouville's constant at the end."""
    t, azi, s = Triaxial(), (F.col("id") * 31) % 3600 / 10.0, (F.col("id") * 7919) % 20000 * 1000.0
    there = _points(spark, sf_dir).withColumn("g", shapes.triaxial_direct(t, F.col("lat"), F.col("lon"), azi, s))
    there = staged(there, "lines")
    back = there.withColumn("b", shapes.triaxial_direct(t, F.col("g.bet2"), F.col("g.omg2"), F.col("g.azi2") + 180.0, s))
    (k2, kp2), square = t._k, lambda f, c: f(F.radians(F.col(f"g.{c}"))) ** 2
    constant = k2 * square(F.cos, "bet2") * square(F.sin, "azi2") - kp2 * square(F.sin, "omg2") * square(F.cos, "azi2")
    return back.select("id", _r(F.col("b.bet2"), "bet", 7), _r(F.abs("b.omg2"), "omg", 7), _r(constant, "constant", 9))


def conformal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jacobi's projection of points on a triaxial Earth, its scale, and back."""
    rows = _points(spark, sf_dir).withColumn("g", shapes.conformal(Triaxial(), F.col("lat"), F.col("lon")))
    rows = staged(rows, "conformal").withColumn("b", shapes.conformal_reverse(Triaxial(), F.col("g.x"), F.col("g.y")))
    return rows.select("id", _r(F.col("g.x"), "x", 1), _r(F.col("g.y"), "y", 1), _r(F.col("g.k"), "k", 9), _r(F.col("b.bet"), "bet", 7), _r(F.abs("b.omg"), "omg", 7))


def _conformal_sql() -> str:
    t, (k2, kp2) = Triaxial(), Triaxial()._k
    nodes, weights = np.polynomial.legendre.leggauss(10)
    rule = ", ".join(f"({(n + 1) / 2!r}, {w / 2!r})" for n, w in zip(nodes.tolist(), weights.tolist()))

    def length(name: str, angle: str, p: float, q: float, m: float) -> str:
        s2 = f"pow(sin(radians({angle}) / 20 * (k + n)), 2)"
        return f"{name} as (select {angle}, sum(w * radians({angle}) / 20 * sqrt(({p!r} + {q - p!r} * {s2}) / (1 - {m!r} * {s2}))) as v from (select distinct {angle} from r), range(20) as i(k), rule group by 1)"

    return f"""with {PTS}, rule(n, w) as (values {rule}), r as (select id, lat, lon, (lon + 270) % 180 - 90 as rest, floor((lon + 270) / 180) - 2 as halves from (select id, lat, lon - 90 as lon from p)),
{length("y", "lat", t.c**2, t.b**2, k2)}, {length("x", "rest", t.a**2, t.b**2, kp2)}, whole as (select 2 * sum(w * radians(90) / 20 * sqrt(({t.a**2!r} + {t.b**2 - t.a**2!r} * pow(sin(radians(90) / 20 * (k + n)), 2)) / (1 - {kp2!r} * pow(sin(radians(90) / 20 * (k + n)), 2)))) as h from range(20) as i(k), rule)
select id, round(x.v + (halves + 1) * h, 1) + 0.0 as x, round(y.v, 1) + 0.0 as y, round(1 / sqrt({k2!r} * pow(cos(radians(lat)), 2) + {kp2!r} * pow(cos(radians(lon)), 2)), 9) as k, round(lat, 7) as bet, round(abs(lon + 90), 7) as omg
from r join y using (lat) join x using (rest), whole"""


def _lines_sql() -> str:
    k2, kp2 = Triaxial()._k
    square = lambda f, c: f"pow({f}(radians({c})), 2)"
    return f"""with {PTS}, q as (select *, (id * 31) % 3600 / 10.0 as azi from p)
select id, round(lat, 7) as bet, round(abs(lon), 7) as omg, round({k2!r} * {square("cos", "lat")} * {square("sin", "azi")} - {kp2!r} * {square("sin", "lon")} * {square("cos", "azi")}, 9) + 0.0 as constant from q"""


def _bulge(s, k):
    return np.sin(s) * np.sqrt(1 + k * np.sin(s) ** 2)


def _arc(s, k):
    return np.sqrt(1 - k / 5 * np.sin(s - 0.3) ** 2)


def trig_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of a parameter of documents as series, fitted once a value of it: values, integrals, and where an integral is reached."""
    k, s = (F.col("n_chars") % 450) / 100.0, F.radians((F.col("doc_id") * 7919) % 36000 / 100.0)
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), k.alias("k"), s.alias("s"))
    # 450 values at most, with some hundred coefficients each
    fits = rows.select("k").distinct().select("k", fitted(_bulge, F.col("k"), sines=True).alias("odd"), fitted(_arc, F.col("k")).alias("whole"))
    rows = rows.join(F.broadcast(staged(fits, "series")), "k").withColumn("y", series.period_integral(F.col("whole"), F.col("s")))
    c, s = F.col("odd"), F.col("s")
    return rows.select(
        "id", _r(series.sines(c, s), "odd", 7), _r(series.sines_integral(c, s), "odd_integral", 7), _r(series.period(F.col("whole"), s), "whole", 7), _r(F.col("y"), "integral", 7), _r(period_inverse(F.col("whole"), F.col("y")), "back", 7)
    )


def _series_sql() -> str:
    nodes, weights = np.polynomial.legendre.leggauss(10)
    rule = ", ".join(f"({(n + 1) / 2!r}, {w / 2!r})" for n, w in zip(nodes.tolist(), weights.tolist()))
    odd, whole = (lambda s: f"sin({s}) * sqrt(1 + k * pow(sin({s}), 2))"), (lambda s: f"sqrt(1 - k / 5 * pow(sin({s} - 0.3), 2))")
    at = "(s / 40 * (j + n))"
    return f"""with rule(n, w) as (values {rule}), r as (select doc_id as id, (n_chars % 450) / 100.0 as k, radians((doc_id * 7919) % 36000 / 100.0) as s from documents),
v as (select id, sum(w * s / 40 * {odd(at)}) as odd_integral, sum(w * s / 40 * {whole(at)}) as integral from r, rule, range(40) as i(j) group by id)
select id, round({odd("s")}, 7) + 0.0 as odd, round(odd_integral, 7) + 0.0 as odd_integral, round({whole("s")}, 7) as whole, round(integral, 7) as integral, round(s, 7) as back from r join v using (id)"""


def _cells_sql() -> str:
    cell = lambda v, size, bits: f"(floor(({v} + {size / 2}) * ({2.0**bits!r} / {size})) + 0.5) * {size} / {2.0**bits!r} - {size / 2}"
    lat, lon = "(lat + id / 1e9)", "(lon + id / 1e10)"
    columns = ", ".join(f"round({cell(v, size, bits)}, 9) as {n}_{c}" for c, by, bx in (("c", 45, 45), ("s", 37, 38)) for n, v, size, bits in (("lat", lat, 180.0, by), ("lon", lon, 360.0, bx)))
    return f"with {PTS} select id, true as within, {columns} from p"


QUERIES = {f.__name__: f for f in (harmonic_circles, raster_points, exact_sums, tolerant_pairs, exact_mercator, local_round_trip, geohash_long, angle_turns, triaxial_inverse, triaxial_direct, conformal_points, trig_series)}
ORACLE_SQL = {
    "harmonic_circles": _circles_sql(),
    "raster_points": _raster_sql(),
    "exact_mercator": f"with {PTS} select id, lon >= 0 or lon = -180 as east, true as wide, round(lat, 7) as lat2, round(abs(lon), 7) as lon2 from p",
    "local_round_trip": f"with {PTS} select id, round(lat, 7) as lat2, round(abs(lon), 7) as lon2, round(lat * 10, 3) as h2 from p",
    "geohash_long": _cells_sql(),
    "triaxial_direct": _lines_sql(),
    "conformal_points": _conformal_sql(),
    "trig_series": _series_sql(),
    "angle_turns": """with d as (select doc_id as id, ((doc_id * 7919) % 36001 - 18000) / 10.0 + 0.03 as a, ((doc_id * 104729) % 14401 - 7200) / 10.0 + 0.04 as b from documents),
s as (select id, a, b, a + b as z, round((a + b) / 360) as n from d)
select id, round(z, 7) as total, round(z - 360 * n, 7) as base, cast(n as bigint) as whole, cast(floor((z - 360 * floor(z / 360)) / 90) as bigint) as quadrant, cast(round(z / 90) as bigint) as quarters,
round(z - 360 * round(b / 360), 7) as near, round(90 * round(z / 90), 7) + 0.0 as cardinal, '00d30''00"N 000d15''00"E' as text from s""",
}
