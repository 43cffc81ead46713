"""The national grid of Great Britain: coordinates on the Airy ellipsoid, and grid references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import transverse
from ..functions.bound import bind, struct
from ..functions.ellipsoid import Ellipsoid
from .geodesics import kernel

# The ellipsoid in feet and the logarithm of the foot, the scale, the origins, and the squares' letters.
AIRY = Ellipsoid(10 ** ((48401603 - 100000000) / 100000000) * 20923713, (20923713 - 20853810) / 20923713)
SCALE = 10 ** ((9998268 - 10000000) / 10000000)
LAT0, LON0, EAST, NORTH = 49.0, -2.0, 400_000.0, -100_000.0
LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"
TILE, GRID, MOST = 100_000.0, 5, 11
#: The squares' numbers begin so many squares west and south of the origin.
WEST, SOUTH = 10, 5
_SHIFT = NORTH - float(transverse.transverse_mercator(0.0, LAT0, 0.0, SCALE, AIRY)["y"])


def forward(lat: Column, lon: Column) -> Column:
    """Struct easting, northing, gamma, k of a point on the Airy ellipsoid."""
    p = kernel(lambda a, b: transverse.transverse_mercator(LON0, a, b, SCALE, AIRY), "x y gamma k", lat, lon)
    return struct(easting=p["x"] + EAST, northing=p["y"] + _SHIFT, gamma=p["gamma"], k=p["k"])


def reverse(easting: Column, northing: Column) -> Column:
    """Struct lat, lon, gamma, k."""
    return kernel(lambda a, b: transverse.transverse_mercator_reverse(LON0, a, b, SCALE, AIRY), "lat lon gamma k", easting - EAST, northing - _SHIFT)


def in_limits(easting: Column, northing: Column) -> Column:
    inside = lambda x, before: (x >= -before * TILE) & (x < (GRID * GRID - before) * TILE)
    return inside(easting, WEST) & inside(northing, SOUTH)


def grid_reference(easting: Column, northing: Column, digits: int = 2) -> Column:
    """``TG5113`` with ``digits`` (0 to 11) digits a coordinate, cut off; null beyond the grid."""

    def written(s: Column) -> Column:
        x, y = F.floor(s["x"] / TILE), F.floor(s["y"] / TILE)
        east, north = (x + WEST).cast("int"), (y + SOUTH).cast("int")
        letter = lambda col, row: F.substring(F.lit(LETTERS), (GRID - row - 1) * GRID + col + 1, F.lit(1))
        big = letter(F.floor(east / GRID).cast("int"), F.floor(north / GRID).cast("int"))
        parts = [big, letter(east % GRID, north % GRID)]
        if digits:
            parts += [F.lpad(F.floor((c - k * TILE) * 10.0 ** (digits - 5)).cast("bigint").cast("string"), digits, "0") for c, k in ((s["x"], x), (s["y"], y))]
        return F.concat(*parts)

    return F.when(in_limits(easting, northing), bind(struct(x=easting, y=northing), written))


def grid_reference_reverse(text: Column, centre: bool = True) -> Column:
    """Struct easting, northing, digits of the centre, or the south-west corner, of a reference's square; null if the text is none."""
    clean = F.upper(F.regexp_replace(text, r"\s", ""))
    part = lambda k: F.regexp_extract(clean, f"^([{LETTERS}])([{LETTERS}])((?:[0-9][0-9]){{0,{MOST}}})$", k)
    half = (F.length(part(3)) / 2).cast("int")

    def read(s: Column) -> Column:
        at = lambda c: F.instr(F.lit(LETTERS), s[c]) - 1
        east = at("a") % GRID * GRID + at("b") % GRID - WEST
        north = (GRID - F.floor(at("a") / GRID) - 1) * GRID + GRID - F.floor(at("b") / GRID) - 1 - SOUTH
        unit = F.lit(TILE) / F.pow(F.lit(10.0), s["half"])
        number = lambda k: F.concat(F.lit("0"), F.substring(s["digits"], k, s["half"])).try_cast("bigint") + (0.5 if centre else 0.0)
        return struct(easting=east * TILE + number(F.lit(1)) * unit, northing=north * TILE + number(s["half"] + 1) * unit, digits=s["half"])

    return F.when(part(1) != "", bind(struct(a=part(1), b=part(2), digits=part(3), half=half), read))
