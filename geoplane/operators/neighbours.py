"""Radius and nearest-neighbour joins of points by geodesic distance, over one index of cells of space."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import geodesic
from ..functions.bound import bind, struct
from ..functions.ellipsoid import WGS84, Ellipsoid
from ..functions.frames import geocentric
from .geodesics import inverse
from .staging import staged

#: Halvings of the cube around the ellipsoid at a cell of each level: the last has sides of about 12 metres.
LEVELS = range(4, 21, 2)
#: Points of a cell that isn't split; a table of cells with so many parents at most is broadcast.
LEAF, SMALL = 64, 20_000
AXES = "xyz"
#: Pairs that are measured at once, about, and metres that a chord may be off.
PAIRS, NOISE = 1 << 16, 1e-8


class Index(NamedTuple):
    """Points by cells of space.

    points: _r (their key), lat, lon, x, y, z, and ix, iy, iz: their cell at the last level. nodes: level, parent, and its children
    (code, n, leaf, and the box of their points), for the root and each cell of over ``leaf`` points. sizes: parents at
    each level that has any, and the most points of a leaf; only points nearer to each other than the last level's
    cells are more than ``leaf`` in one.
    """

    points: DataFrame
    nodes: DataFrame
    key: str
    sizes: dict[int, tuple[int, int]]
    total: int
    leaf: int
    e: Ellipsoid


def _placed(points: DataFrame, key: str, name: str, e: Ellipsoid) -> DataFrame:
    """(name, lat, lon, x, y, z, ix, iy, iz): points in space and their cell at the last level, without those that are nowhere. Written, so that plans on it stay small."""
    p = points.select(F.col(key).alias(name), "lat", "lon", geocentric(F.col("lat"), F.col("lon"), F.lit(0.0), e).alias("_p"))
    p = p.filter(~F.isnan("_p.x") & F.col("_p.x").isNotNull()).select(name, "lat", "lon", *(F.col(f"_p.{c}").alias(c) for c in AXES))
    half = 1.001 * max(e.a, e.b)
    return staged(p.select("*", *(F.floor((F.col(c) + half) * ((1 << LEVELS[-1]) / (2 * half))).cast("bigint").alias(f"i{c}") for c in AXES)), "placed")


def _code(level: Column) -> Column:
    """The cell at a level of points with their last level's."""
    up = (F.lit(LEVELS[-1]) - level).cast("int")
    i = [F.call_function("shiftright", F.col(f"i{c}"), up) for c in AXES]
    return (i[0] * (1 << 20) + i[1]) * (1 << 20) + i[2]


def _parent(code: Column, steps: int) -> Column:
    """The cell around a cell."""
    k = F.array(*(F.call_function("shiftright", code.bitwiseAND(((1 << 20) - 1) << (20 * a)), F.lit(20 * a + steps)) for a in (2, 1, 0)))
    return bind(k, lambda v: (F.get(v, F.lit(0)) * (1 << 20) + F.get(v, F.lit(1))) * (1 << 20) + F.get(v, F.lit(2)))


def _box(prefix: str = "") -> list[Column]:
    return [f(c).alias(f"{prefix}{c}{n}") for c in AXES for f, n in ((F.min, 0), (F.max, 1))]


def build_index(points: DataFrame, key: str, e: Ellipsoid = WGS84, leaf: int = LEAF) -> Index:
    """An index of ``points`` (key, lat, lon). Points are counted by cell at nine levels, in each task before the shuffle; the cells are written."""
    placed = _placed(points, key, "_r", e)
    at = placed.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    cells = at.groupBy("level", _code(F.col("level")).alias("code")).agg(F.count(F.lit(1)).alias("n"), *_box())
    fields = ["level", "code", "n", ((F.col("n") <= leaf) | (F.col("level") == LEVELS[-1])).alias("leaf"), *(f"{c}{k}" for c in AXES for k in (0, 1))]
    up = F.when(F.col("level") == LEVELS[0], 0).otherwise(_parent(F.col("code"), LEVELS.step))
    nodes = cells.groupBy("level", up.alias("parent")).agg(F.collect_list(F.struct(*fields)).alias("children"), F.sum("n").alias("points"))
    nodes = staged(nodes.filter((F.col("points") > leaf) | (F.col("level") == LEVELS[0])), "cells")
    most = F.array_max(F.transform("children", lambda c: F.when(c["leaf"], c["n"]).otherwise(0)))
    found = nodes.groupBy("level").agg(F.count(F.lit(1)).alias("parents"), F.max(most).alias("most"), F.sum("points").alias("points")).collect()
    sizes = {r.level: (r.parents, r.most) for r in sorted(found)}
    return Index(placed, nodes, key, sizes, next((r.points for r in found if r.level == LEVELS[0]), 0), leaf, e)


def _least(box: Column, own: Column | None = None) -> Column:
    """The least distance of a box to the row's point, or to another box."""
    ends = ((F.col(c), F.col(c)) if own is None else (own[f"{c}0"], own[f"{c}1"]) for c in AXES)
    return F.sqrt(sum(F.pow(F.greatest(box[f"{c}0"] - hi, lo - box[f"{c}1"], F.lit(0.0)), F.lit(2.0)) for c, (lo, hi) in zip(AXES, ends)))


def _most(box: Column, own: Column | None = None) -> Column:
    ends = ((F.col(c), F.col(c)) if own is None else (own[f"{c}0"], own[f"{c}1"]) for c in AXES)
    return F.sqrt(sum(F.pow(F.greatest(box[f"{c}1"] - lo, hi - box[f"{c}0"]), F.lit(2.0)) for c, (lo, hi) in zip(AXES, ends)))


def _longest(chord: Column, e: Ellipsoid) -> Column:
    """The longest geodesic between points with a chord: arcs bend no more than circles of the least radius of curvature."""
    r = min(e.a, e.b) ** 2 / max(e.a, e.b)
    return F.when(chord < 1.99 * r, 2 * r * F.asin(F.least(chord / (2 * r), F.lit(1.0))) * (1 + 1e-12)).otherwise(math.pi * max(e.a, e.b))


SLACK = 1 + 1e-12


def _reached(left: DataFrame, index: Index, most: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(at, cell): the leaves ``cell`` that may matter to some row of ``left`` (placed) in its cell ``at`` of the index's last level.

    Both sides go down together: at each level the cells of rows, with the box of these, and the cells of points near them
    are replaced by their children. ``low`` and ``high`` bound the distances between two of them (in a straight line,
    along the ellipsoid), ``bound`` is what the parent's rows are known to need at most; ``keep`` leaves out those beyond. A
    leaf stays as it is. What is kept of a level is written.
    """
    spark, last = left.sparkSession, list(index.sizes)[-1]
    cells = spark.range(1).select(F.lit(0).cast("bigint").alias("at"), F.lit(most).alias("bound"), F.lit(0).cast("bigint").alias("code"))
    leaves, before = None, LEVELS[0]
    for level, (parents, _) in index.sizes.items():
        own = index.nodes.filter(F.col("level") == level).select(F.col("parent").alias("code"), "children")
        opened = cells.join(F.broadcast(own) if parents <= SMALL else own, "code").select("at", "bound", F.explode("children").alias("cell"))
        opened = opened if leaves is None else opened.unionByName(leaves)
        up = F.lit(0).cast("bigint") if level == LEVELS[0] else _code(F.lit(before))
        rows = left.groupBy(up.alias("at"), _code(F.lit(level)).alias("_to")).agg(*_box("_")).select("at", "_to", F.struct(*(F.col(f"_{c}{k}").alias(f"{c}{k}") for c in AXES for k in (0, 1))).alias("_own"))
        pairs = rows.join(opened, "at").withColumn("low", _least(F.col("cell"), F.col("_own"))).filter(F.col("low") <= F.col("bound") * SLACK)
        kept = keep(pairs.select(F.col("_to").alias("at"), "bound", "cell", "low", _longest(_most(F.col("cell"), F.col("_own")), index.e).alias("high")))
        kept = kept.select("at", "bound", "cell")
        kept = kept if level == last else staged(kept, "reached")  # read twice from here on
        leaves, cells, before = kept.filter("cell.leaf"), kept.filter("not cell.leaf").select("at", "bound", "cell.code"), level
    return leaves.select("at", "cell")


def _leaf_points(rows: DataFrame, index: Index, *fields: str) -> DataFrame:
    """Rows (with ``cell``, a leaf) and ``_points``, structs of the ``fields`` of its points.

    A leaf's points come as one array of ``leaf`` at most. One with more (all within some metres) is dealt by a hash, to as many arrays.
    """
    used = [level for level, (_, most) in index.sizes.items() if most]
    points = index.points.withColumn("level", F.explode(F.array(*map(F.lit, used)))).withColumn("code", _code(F.col("level")))
    leaf = index.nodes.filter(F.col("level").isin(used)).select(F.explode("children").alias("c")).filter("c.leaf").select("c.level", "c.code", F.ceil(F.col("c.n") / index.leaf).alias("_parts"))
    points = points.join(leaf, ["level", "code"]).withColumn("part", F.pmod(F.xxhash64("_r"), F.col("_parts")))
    arrays = points.groupBy("level", "code", "part").agg(F.collect_list(F.struct(*fields)).alias("_points"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("cell.n") / index.leaf), F.lit(1)) - 1)
    rows = rows.select("*", F.col("cell.level").alias("level"), F.col("cell.code").alias("code"), F.explode(parts).alias("part")).drop("cell")
    return rows.join(arrays, ["level", "code", "part"])


def _met(rows: DataFrame, index: Index, near: Callable[[Column], Column]) -> DataFrame:
    """Rows (with ``cell``, a leaf) and, of its points as structs chord, _r, lat, lon, those that ``near`` keeps of an array: ``pair``."""
    chord = lambda p: F.sqrt(sum((F.col(c) - p[c]) ** 2 for c in AXES))
    found = F.transform("_points", lambda p: struct(chord=chord(p), _r=p["_r"], lat=p["lat"], lon=p["lon"]))
    met = _leaf_points(rows, index, "_r", "lat", "lon", *AXES).withColumn("_found", near(found))
    return met.withColumn("pair", F.explode("_found")).drop("_points", "_found", "level", "code", "part")


def _measured(pairs: DataFrame, e: Ellipsoid) -> DataFrame:
    return pairs.withColumn("distance", inverse(F.col("lat"), F.col("lon"), F.col("pair.lat"), F.col("pair.lon"), e, "s12")["s12"])


def _named(pairs: DataFrame, left_key: str, index: Index, *more: str) -> DataFrame:
    return pairs.select(F.col("_l").alias(left_key), F.col("pair._r").alias(index.key), *more)


def _none(left: DataFrame, index: Index, left_key: str, *more: str) -> DataFrame:
    """No rows, with the columns of a join."""
    empty = left.limit(0).select(F.col(left_key).alias("_l")).join(index.points.limit(0).select(F.struct("_r").alias("pair")), F.lit(True))
    return _named(empty.withColumn("distance", F.lit(0.0)).withColumn("rank", F.lit(0)), left_key, index, *more)


def _at(index: Index) -> Column:
    return _code(F.lit(list(index.sizes)[-1]))


def _crossed(groups: DataFrame, left_key: str, right_key: str, radius: float, e: Ellipsoid) -> DataFrame:
    """(left_key, right_key, distance) of the pairs of ``_rows`` and ``_points`` (arrays of key, lat, lon) in each row that are at most ``radius`` apart."""
    kind = lambda array: groups.schema[array].dataType.elementType[0].dataType
    schema = StructType([StructField(left_key, kind("_rows")), StructField(right_key, kind("_points")), StructField("distance", DoubleType())])

    def placed(points) -> dict:
        lat, lon = (pc.struct_field(points, k).to_numpy(zero_copy_only=False) for k in (1, 2))
        sb, cb = geodesic.reduced(lat, e)
        s, c = geodesic.sincosd(lon)
        return {"lat": lat, "lon": geodesic.normalized(lon), "sb": sb, "cb": cb, "x": e.a * cb * c, "y": e.a * cb * s, "z": e.b * sb}

    def run(batches):
        for batch in batches:
            left, right = batch.column("_rows"), batch.column("_points")
            n, m = (pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64) for v in (left, right))
            left, right = left.flatten(), right.flatten()
            keys, others, p, r = pc.struct_field(left, 0), pc.struct_field(right, 0), placed(left), placed(right)
            first, second, ends = np.cumsum(n) - n, np.cumsum(m) - m, np.cumsum(n * m)
            cuts = np.flatnonzero(np.diff(ends // PAIRS, prepend=0, append=-1))
            for a, b in zip([0, *cuts], cuts.tolist()):
                if a == b:
                    continue
                count = (n * m)[a:b]
                of = np.repeat(np.arange(a, b), count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                i, j = first[of] + k // m[of], second[of] + k % m[of]
                chord = np.sqrt((p["x"][i] - r["x"][j]) ** 2 + (p["y"][i] - r["y"][j]) ** 2 + (p["z"][i] - r["z"][j]) ** 2)
                near = chord <= radius * SLACK + NOISE
                i, j, chord = i[near], j[near], chord[near]
                east = r["lon"][j] - p["lon"][i]
                lam = np.radians(east - 360 * np.rint(east / 360))
                distance = geodesic.short_distance(p["sb"][i], p["cb"][i], r["sb"][j], r["cb"][j], lam, e)
                far = chord > geodesic.SHORT * min(e.a, e.b) * 0.9
                if far.any():
                    distance[far] = geodesic.inverse(p["lat"][i[far]], p["lon"][i[far]], r["lat"][j[far]], r["lon"][j[far]], e, ("s12",))["s12"]
                found = distance <= radius
                i, j = pa.array(i[found]), pa.array(j[found])
                yield pa.RecordBatch.from_arrays([keys.take(i), others.take(j), pa.array(distance[found])], names=[left_key, right_key, "distance"])

    return groups.select("_rows", "_points").mapInArrow(run, schema)


def radius_join(left: DataFrame, right: DataFrame | Index, left_key: str, right_key: str, radius: float, e: Ellipsoid = WGS84) -> DataFrame:
    """(left_key, right_key, distance) of the pairs at most ``radius`` metres apart along the ellipsoid. ``right`` can be an index.

    Rows go by cells too, in arrays of about a leaf's size, dealt by a hash; an array meets each leaf in reach of its cell, and
    their pairs are measured together. Work grows with the pairs found, shuffle with the rows and the leaves in reach of them.
    """
    index = right if isinstance(right, Index) else build_index(right, right_key, e)
    if not index.sizes:
        return _none(left, index, left_key, "distance")
    rows = _placed(left, left_key, "_l", index.e)
    leaves = _reached(rows, index, radius, lambda pairs: pairs)
    rows = rows.select("_l", "lat", "lon", _at(index).alias("at"), F.monotonically_increasing_id().alias("_n"))  # keys may repeat
    sizes = rows.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / index.leaf).alias("_arrays"))
    arrays = rows.join(sizes, "at").groupBy("at", F.pmod(F.xxhash64("_n"), F.col("_arrays")).alias("_array")).agg(F.collect_list(F.struct("_l", "lat", "lon")).alias("_rows"))
    met = _leaf_points(arrays.join(leaves, "at").select("_rows", "cell"), index, "_r", "lat", "lon")
    return _crossed(met, left_key, index.key, radius, index.e)


def within_radius(left: DataFrame, right: DataFrame | Index, left_key: str, right_key: str, radius: float, e: Ellipsoid = WGS84) -> DataFrame:
    """The rows of ``left`` with some row of ``right`` at most ``radius`` metres away."""
    return left.join(nearest_join(left, right, left_key, right_key, 1, e, most=radius).select(left_key), left_key, "left_semi")


def nearest_join(left: DataFrame, right: DataFrame | Index, left_key: str, right_key: str, k: int, e: Ellipsoid = WGS84, most: float = math.inf, least: float = -1.0, tolerance: float = 0.0) -> DataFrame:
    """(left_key, right_key, distance, rank) of the ``k`` nearest of ``right`` for each of ``left``; ties by right_key. ``right`` can be an index.

    Only pairs at most ``most`` and more than ``least`` metres apart count (0 leaves out a point itself, in a join of
    a table with itself). With a ``tolerance`` the distance of each rank is less than so many metres over the least possible,
    and cells that can't better it by more aren't opened.

    The counts of cells alone bound the k-th distance, of the rows of a cell and then of each row; cells that begin
    beyond it are left out, so a dense cell costs no more than a thin one. Points are only met in leaves; of each leaf those
    go on whose chord is no longer than the geodesic of its k-th shortest chord can be, and of all these the same
    again, before geodesics are measured. Keys must be unique in each table.
    """
    index = right if isinstance(right, Index) else build_index(right, right_key, e)
    if k < 1 or not index.sizes:
        return _none(left, index, left_key, "distance", "rank")
    infinite = F.lit(math.inf)

    def nearest_cells(pairs: DataFrame) -> DataFrame:
        of_cell = Window.partitionBy("at")
        sure = F.when(F.col("low") > least, F.col("cell.n")).otherwise(0)
        pairs = pairs.withColumn("_sum", F.sum(sure).over(of_cell.orderBy("high", "cell.level", "cell.code").rowsBetween(Window.unboundedPreceding, 0)))
        pairs = pairs.withColumn("bound", F.least("bound", F.coalesce(F.min(F.when(F.col("_sum") >= k, F.col("high"))).over(of_cell), infinite)))
        needed = (F.col("high") <= F.col("bound")) if tolerance else F.lit(False)
        return pairs.filter((F.col("low") <= (F.col("bound") - tolerance) * SLACK) | needed)

    rows = _placed(left, left_key, "_l", index.e)
    around = _reached(rows, index, most, nearest_cells).groupBy("at").agg(F.collect_list("cell").alias("_cells"))
    rows = rows.withColumn("at", _at(index)).join(around, "at").select("_l", "lat", "lon", *AXES, "_cells")
    of_row = F.transform("_cells", lambda c: struct(high=_longest(_most(c), index.e), low=_least(c), cell=struct(level=c["level"], code=c["code"], n=c["n"])))

    def bounded(s: Column) -> Column:
        """The cells of a row, by their far ends, up to where k points are sure."""
        step = lambda a, c: struct(sum=a["sum"] + F.when(c["low"] > least, c["cell"]["n"]).otherwise(0), bound=F.when((a["sum"] < k) & (a["sum"] + F.when(c["low"] > least, c["cell"]["n"]).otherwise(0) >= k), c["high"]).otherwise(a["bound"]))
        return struct(cells=s["cells"], bound=F.aggregate(s["cells"], struct(sum=F.lit(0).cast("bigint"), bound=F.lit(float(most))), step)["bound"])

    rows = rows.withColumn("_s", bind(struct(cells=F.array_sort(of_row)), bounded))
    needed = lambda c: (c["high"] <= F.col("_s.bound")) if tolerance else F.lit(False)
    kept = F.filter("_s.cells", lambda c: (c["low"] <= (F.least(F.col("_s.bound"), F.lit(float(most))) - tolerance) * SLACK) | needed(c))
    rows = rows.select("_l", "lat", "lon", *AXES, F.least(F.col("_s.bound"), F.lit(float(most))).alias("bound"), F.explode(kept).alias("_c"))
    rows = rows.select("_l", "lat", "lon", *AXES, "bound", F.col("_c.cell").alias("cell"))

    def near(found: Column) -> Column:
        close = lambda p: p["chord"] <= F.col("bound") * SLACK
        kth = lambda s: struct(all=s["all"], cut=_longest(F.get(F.filter(s["all"], lambda p: p["chord"] > least), F.lit(k - 1))["chord"], index.e))
        return bind(struct(all=F.array_sort(F.filter(found, close))), kth, lambda s: F.filter(s["all"], lambda p: p["chord"] <= s["cut"]))

    pairs, of_row = _met(rows, index, near), Window.partitionBy("_l")
    sure = F.when(F.col("pair.chord") > least, F.col("pair.chord"))
    pairs = pairs.select("_l", "lat", "lon", "pair", F.count(sure).over(of_row.orderBy("pair").rowsBetween(Window.unboundedPreceding, 0)).alias("_k"))
    kth = F.min(F.when(F.col("_k") >= k, F.col("pair.chord"))).over(of_row)
    pairs = pairs.withColumn("_bound", F.coalesce(_longest(kth, index.e), infinite)).filter(F.col("pair.chord") <= F.col("_bound"))
    found = _measured(pairs, index.e).filter((F.col("distance") <= most) & (F.col("distance") > least))
    rank = F.row_number().over(of_row.orderBy("distance", "pair._r"))
    return _named(found.withColumn("rank", rank).filter(F.col("rank") <= k), left_key, index, "distance", "rank")
