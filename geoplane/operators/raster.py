"""Heights from a grid over the globe (of a geoid, say) at very many points: the grid as a table of tiles, joined to the points by tile."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.raster import CELLS, INNER, NORTH, SOUTH, between
from .geodesics import kernel

#: Cells of a tile's side, without its border.
SIDE = 8


class Raster(NamedTuple):
    """A grid: its rows as a table (row int, cells array<double>), from 90 N southward, each from 0 E eastward; and how many rows and columns it has."""

    table: DataFrame
    rows: int
    columns: int


def _header(start: bytes) -> tuple[dict[str, str], list[str], int]:
    """Keys of comment lines, the four words of a grey map's header, and where its pixels begin."""
    words, keys, at = [], {}, 0
    while len(words) < 4:
        end = start.index(b"\n", at)
        line = start[at:end].decode("latin-1")
        at = end + 1
        if line.startswith("#"):
            parts = line[1:].split(None, 1)
            keys[parts[0] if parts else ""] = parts[1].strip() if len(parts) > 1 else ""
        else:
            words += line.split()
    return keys, words, at


def read_raster(spark: SparkSession, path: str) -> Raster:
    """A binary grey map with 16-bit values; comment lines ``Offset`` and ``Scale`` make heights of them.

    The driver reads the header alone. One task reads the file, which has 2 GB at most, and gives its rows, a few at a
    time; all else is by rows and tiles.
    """
    file = spark.read.format("binaryFile").load(path).select("content")
    keys, words, at = _header(bytes(file.select(F.substring("content", 1, 8192)).first()[0]))
    width, height, most = map(int, words[1:4])
    if words[0] != "P5" or most != 65535 or width % 2 or height % 2 == 0 or "Offset" not in keys or "Scale" not in keys:
        raise ValueError("not a grid of heights")
    offset, scale = float(keys["Offset"]), float(keys["Scale"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                pixels = np.frombuffer(content.as_buffer(), ">u2", width * height, at).reshape(height, width)
                for k in range(0, height, 64):
                    part = pixels[k : k + 64]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(offset + scale * part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part)), pa.int32()), lists], ["row", "cells"])

    return Raster(file.mapInArrow(rows, "row int, cells array<double>"), height, width)


def tiles(raster: Raster, side: int = SIDE) -> DataFrame:
    """(ty, tx, cells): tiles of ``side`` rows and columns with a border of one cell before and two after, row by row.

    Beyond a pole come the rows across it; the column after the last is the first. Rows are cut to stretches of a tile's
    width and brought together by tile: native columns, and no task sees more than a row or a tile.
    """
    side = min(side, raster.columns - 2)
    half = raster.columns // 2
    turned = F.concat(F.slice("cells", half + 1, raster.columns - half), F.slice("cells", 1, half))
    across = F.when(F.col("row") == 1, -1).when(F.col("row") == raster.rows - 2, raster.rows)
    rows = raster.table.unionByName(raster.table.select(across.cast("int").alias("row"), turned.alias("cells")).filter("row is not null"))
    if raster.rows == 3:  # the middle row is across both poles
        rows = rows.unionByName(raster.table.filter("row = 1").select(F.lit(3).alias("row"), turned.alias("cells")))
    high, wide = -(-(raster.rows - 1) // side), -(-raster.columns // side)
    ring = F.concat(F.slice("cells", raster.columns, 1), "cells", F.slice("cells", 1, side + 2))
    ty = F.sequence(F.greatest(F.floor((F.col("row") - 2) / side), F.lit(0)), F.least(F.floor((F.col("row") + 1) / side), F.lit(high - 1)))
    cut = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda tx: F.struct(tx.alias("tx"), F.slice("_ring", tx * side + 1, side + 3).alias("part")))
    parts = rows.withColumn("_ring", ring).withColumn("ty", F.explode(ty)).withColumn("_cut", F.explode(cut)).select("ty", "_cut.tx", F.struct("row", "_cut.part").alias("_part"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["part"]))
    return parts.groupBy("ty", "tx").agg(whole.alias("cells"))


def raster_heights(points: DataFrame, raster: Raster, smooth: bool = True, name: str = "height", lat: str = "lat", lon: str = "lon", table: DataFrame | None = None, side: int = SIDE) -> DataFrame:
    """``points`` with a column of heights between the grid's cells; null where a coordinate is null, not finite or out of range.

    ``table`` is the grid's ``tiles``, if they are there already. Points meet their tile by an equi-join, and take the twelve cells
    around from it; a tile with very many points is split by Spark's adaptive skew join. Bilinear, or by a cubic fitted
    to the twelve cells; beside a pole by one that is the same there at all longitudes of a cell.
    """
    side = min(side, raster.columns - 2)
    table = tiles(raster, side) if table is None else table
    fine = F.col(lat).between(-90, 90) & (F.abs(F.col(lon)) < float("inf"))
    y, x = F.when(fine, (90 - F.col(lat)) * ((raster.rows - 1) / 180)), F.when(fine, F.pmod(F.col(lon), F.lit(360.0)) * (raster.columns / 360))
    placed = points.withColumn("_y", y).withColumn("_x", x)
    placed = placed.withColumn("_iy", F.least(F.floor("_y"), F.lit(raster.rows - 2))).withColumn("_fx", F.col("_x") - F.floor("_x")).withColumn("_ix", F.pmod(F.floor("_x"), F.lit(raster.columns)))
    placed = placed.withColumn("_ty", F.floor(F.col("_iy") / side)).withColumn("_tx", F.floor(F.col("_ix") / side))
    joined = placed.join(table.select(F.col("ty").alias("_ty"), F.col("tx").cast("bigint").alias("_tx"), F.col("cells").alias("_cells")), ["_ty", "_tx"], "left")
    row, column = F.col("_iy") - F.col("_ty") * side + 1, F.col("_ix") - F.col("_tx") * side + 1
    cell = lambda r, c: F.get("_cells", ((row + r) * (side + 3) + column + c).cast("int"))
    kind = F.when(F.col("_iy") == 0, NORTH).when(F.col("_iy") == raster.rows - 2, SOUTH).otherwise(INNER)
    values = [cell(r, c) for r, c in CELLS]

    def run(x, y, kind, *cells):
        return {"n": between(np.stack(cells), x, y, kind, smooth)}

    height = kernel(run, "n", F.col("_fx"), F.col("_y") - F.col("_iy"), kind, *values)["n"]
    return joined.select(*points.columns, height.alias(name))


def above_ellipsoid(points: DataFrame, raster: Raster, h: str, name: str = "height", **how) -> DataFrame:
    """``points`` with their heights ``h`` above the grid's geoid as heights above the ellipsoid."""
    return raster_heights(points, raster, name="_n", **how).withColumn(name, F.col(h) + F.col("_n")).drop("_n")


def above_geoid(points: DataFrame, raster: Raster, h: str, name: str = "height", **how) -> DataFrame:
    """``points`` with their heights ``h`` above the ellipsoid as heights above the grid's geoid."""
    return raster_heights(points, raster, name="_n", **how).withColumn(name, F.col(h) - F.col("_n")).drop("_n")


def raster_of(cells: DataFrame, rows: int, columns: int, row: Column, column: Column, value: Column) -> Raster:
    """A grid of a table's values: the sum of ``value`` in each cell, 0 where there is none."""
    own = cells.groupBy(row.cast("int").alias("row"), column.cast("int").alias("_c")).agg(F.sum(value).alias("_v"))
    lists = own.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_v"))).alias("_m"))
    every = cells.sparkSession.range(rows).select(F.col("id").cast("int").alias("row"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.coalesce(F.try_element_at("_m", c), F.lit(0.0)))
    return Raster(every.join(lists, "row", "left").select("row", filled.alias("cells")), rows, columns)
