"""Areas and lengths of polygons and polylines, by geodesic, rhumb or authalic great-circle edges."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesic, rhumb
from ..functions.ellipsoid import WGS84, Ellipsoid, authalic_sphere
from .geodesics import kernel


def _authalic(lat1, lon1, lat2, lon2, e: Ellipsoid) -> dict[str, np.ndarray]:
    """Great circles of the sphere of the same area, between points of the same authalic latitude."""
    one, two = (np.degrees(np.arcsin(np.clip(rhumb.sin_authalic(x, e), -1, 1))) for x in (lat1, lat2))
    return geodesic.inverse(one, lon1, two, lon2, authalic_sphere(e), fields=("s12", "area12"))


#: What an edge is, by name.
EDGES = {"geodesic": partial(geodesic.inverse, fields=("s12", "area12")), "rhumb": rhumb.rhumb_inverse, "authalic": _authalic}


def transit(lon1: Column, lon2: Column) -> Column:
    """1 or -1 if the shorter way crosses the prime meridian going east or west, else 0."""
    step = F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180
    step = F.when((step == -180) & (lon2 - lon1 > 0), F.lit(180.0)).otherwise(step)
    a, b = F.pmod(lon1 + 180, F.lit(360.0)) - 180, F.pmod(lon2 + 180, F.lit(360.0)) - 180
    return F.when((step > 0) & (a < 0) & (b >= 0), 1).when((step < 0) & (a >= 0) & (b < 0), -1).otherwise(0)


def transit_direct(lon1: Column, lon2: Column) -> Column:
    """Crossings of the prime meridian on the way between longitudes that are not reduced."""
    return (F.floor(lon2 / 360) - F.floor(lon1 / 360)).cast("int")


def reduced_area(total: Column, crossings: Column, whole: float, reverse: bool, sign: bool) -> Column:
    """The area of a ring from the sum under its edges and their crossings: counter-clockwise is positive, or clockwise with ``reverse``.

    With ``sign`` it is in (-whole / 2, whole / 2], else in [0, whole): that of what is on the left (right) of the ring.
    """
    area = total - F.rint(total / whole) * whole
    area = area + F.when(crossings % 2 != 0, F.when(area < 0, F.lit(whole / 2)).otherwise(F.lit(-whole / 2))).otherwise(F.lit(0.0))
    area = area if reverse else -area  # an edge's area is positive going east, as clockwise rings in the north do
    if sign:
        return F.when(area > whole / 2, area - whole).when(area <= -whole / 2, area + whole).otherwise(area) + 0.0
    return F.when(area >= whole, area - whole).when(area < 0, area + whole).otherwise(area) + 0.0


def _finish(sums: DataFrame, ring: str, polyline: bool, reverse: bool, sign: bool, e: Ellipsoid) -> DataFrame:
    out = sums.select(ring, "n", F.when(F.col("n") > 1, F.col("perimeter")).otherwise(F.lit(0.0)).alias("perimeter"), "_s", "_c")
    if polyline:
        return out.select(ring, "n", "perimeter")
    area = reduced_area(F.col("_s"), F.col("_c"), e.area, reverse, sign)
    return out.select(ring, "n", "perimeter", F.when(F.col("n") > 1, area).otherwise(F.lit(0.0)).alias("area"))


def polygon_areas(
    points: DataFrame, ring: str, order: list[str], e: Ellipsoid = WGS84, edges: str = "geodesic", polyline: bool = False, reverse: bool = False, sign: bool = True
) -> DataFrame:
    """(ring, n, perimeter, area) of rings of points (lat, lon), see ``reduced_area``; of a ``polyline`` (ring, n, perimeter).

    ``edges``: geodesic, rhumb, or authalic. They are made by a window on the ring, measured in Arrow batches, and
    summed by key with partial sums. A ring of one point has no length; a null coordinate makes its ring's results NaN.
    """
    w = Window.partitionBy(ring).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.lead(F.lit(1)).over(w).isNull()
    after = lambda c: F.when(last, F.first(c).over(whole)).otherwise(F.lead(c).over(w))
    pairs = points.select(ring, "lat", "lon", after("lat").alias("_lat"), after("lon").alias("_lon"), last.alias("_last"))
    g = kernel(partial(EDGES[edges], e=e), "s12 area12", F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    pairs = pairs.withColumn("_g", g).withColumn("_t", transit(F.col("lon"), F.col("_lon")))
    length = F.when(F.col("_last"), 0.0).otherwise(F.col("_g.s12")) if polyline else F.col("_g.s12")
    sums = pairs.groupBy(ring).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("perimeter"), F.sum("_g.area12").alias("_s"), F.sum("_t").alias("_c"))
    return _finish(sums, ring, polyline, reverse, sign, e)


def candidate_areas(
    points: DataFrame, ring: str, order: list[str], candidates: DataFrame, e: Ellipsoid = WGS84, edges: str = "geodesic", polyline: bool = False, reverse: bool = False, sign: bool = True
) -> DataFrame:
    """``candidates`` (ring, lat, lon, more) with n, perimeter, area that the ring would have with that point added at its end.

    Rings are summed once; each candidate adds two edges. Candidates of rings that have no points stand alone.
    """
    w = Window.partitionBy(ring).orderBy(*order)
    pairs = points.select(ring, "lat", "lon", F.lead("lat").over(w).alias("_lat"), F.lead("lon").over(w).alias("_lon"), F.row_number().over(w).alias("_k"), F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    g = kernel(partial(EDGES[edges], e=e), "s12 area12", F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    pairs = pairs.withColumn("_g", g)
    inner = ~F.col("_last")
    at = lambda c, k: F.max(F.when(k, F.struct("lat", "lon"))).alias(c)
    sums = pairs.groupBy(ring).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(inner, F.col("_g.s12")).otherwise(0.0)).alias("_p"), F.sum(F.when(inner, F.col("_g.area12")).otherwise(0.0)).alias("_a"),
        F.sum(F.when(inner, transit(F.col("lon"), F.col("_lon"))).otherwise(0)).alias("_c"), at("_first", F.col("_k") == 1), at("_end", F.col("_last")),
    )
    edge = lambda a, b: kernel(partial(EDGES[edges], e=e), "s12 area12", F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))
    all_ = candidates.withColumn("_new", F.struct("lat", "lon")).join(sums, ring, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    all_ = all_.withColumn("_to", edge("_end", "_new")).withColumn("_back", edge("_new", "_first"))
    area = F.col("_a") + F.col("_to.area12") + F.col("_back.area12")
    crossed = F.col("_c") + transit(F.col("_end.lon"), F.col("lon")) + transit(F.col("lon"), F.col("_first.lon"))
    some = F.col("_n") > 0
    length = F.col("_p") + F.col("_to.s12") + (F.lit(0.0) if polyline else F.col("_back.s12"))
    out = [*candidates.columns, (F.col("_n") + 1).alias("n"), F.when(some, length).otherwise(0.0).alias("perimeter")]
    if not polyline:
        out.append(F.when(some, reduced_area(area, crossed, e.area, reverse, sign)).otherwise(0.0).alias("area"))
    return all_.select(*out)


def ring_points(starts: DataFrame, edges: DataFrame, ring: str, order: str, e: Ellipsoid = WGS84) -> DataFrame:
    """(ring, order, lat, lon): the vertices of rings that start at ``starts`` (ring, lat, lon) and go on by ``edges`` (ring, order, azi, s).

    Each vertex is reckoned from the one before, so a ring is worked off in one task. Longitudes are not reduced.
    The first vertex has the order null. Edges of a ring that has no start give NaN.
    """
    both = edges.select(ring, order, "azi", "s").join(starts.select(ring, F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), ring, "full")
    schema = f"{ring} {starts.schema[ring].dataType.simpleString()}, {order} {edges.schema[order].dataType.simpleString()}, lat double, lon double"

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["azi"].notna()].sort_values(order, kind="stable") if rows["azi"].notna().any() else rows.iloc[:0]
        return rows

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        lat, lon = (float(rows[c].iloc[0]) if pd.notna(rows[c].iloc[0]) else float("nan") for c in ("_lat", "_lon"))
        out = [(key[0], None, lat, lon)]
        for r in walk(rows).itertuples(index=False):
            g = geodesic.direct(lat, lon, r.azi, r.s, e, unroll=True, fields=("lat2", "lon2"))
            lat, lon = float(g["lat2"][0]), float(g["lon2"][0])
            out.append((key[0], getattr(r, order), lat, lon))
        return pd.DataFrame(out, columns=[ring, order, "lat", "lon"])

    return both.groupBy(ring).applyInPandas(run, schema)
