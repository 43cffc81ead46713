"""Cell and grid codes, as native columns. A code of a point that is not a number, or beyond a pole, is null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import ang_normalize
from .bound import bind, struct

# The letters of the codes.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
GARS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
GEOREF = "ABCDEFGHJKLMNPQRSTUVWXYZ"


def _good(lat: Column, lon: Column) -> Column:
    return ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90)


def _east(lon: Column) -> Column:
    """Longitude in [0, 360) from the date line."""
    x = ang_normalize(lon)
    return F.when(x == 180, F.lit(0.0)).otherwise(x + 180)


def _letter(letters: str, k: Column) -> Column:
    return F.substring(F.lit(letters), (k + 1).cast("int"), F.lit(1))


def _spread(x: Column) -> Column:
    """The low 30 bits of a bigint, one to each second bit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def geohash(lat: Column, lon: Column, length: int = 12) -> Column:
    """Base-32 code of up to 18 characters: bits of longitude and latitude in turn, spread by masks into one number of 60 bits, and one of 30 for what follows the twelfth character."""
    more = 15 if length > 12 else 0
    y = F.least(F.floor((lat + 90) * (2.0 ** (30 + more) / 180.0)), F.lit(2 ** (30 + more) - 1)).cast("bigint")
    x = F.floor(_east(lon) * (2.0 ** (30 + more) / 360.0)).cast("bigint")
    joined = lambda x, y: F.shiftleft(_spread(x), 1).bitwiseOR(_spread(y))
    low = F.lit((1 << more) - 1)
    both = lambda s: struct(n=joined(F.shiftright(s["x"], more), F.shiftright(s["y"], more)), rest=joined(s["x"].bitwiseAND(low), s["y"].bitwiseAND(low)))
    letters = lambda n, top, count: [_letter(GEOHASH, F.shiftright(n, top - 5 * k).bitwiseAND(F.lit(31))) for k in range(count)]
    written = lambda s: F.concat(*letters(s["n"], 55, min(length, 12)), *letters(s["rest"], 25, max(length - 12, 0)))
    return F.when(_good(lat, lon), bind(struct(x=x, y=y), both, written))


def _gathered(x: Column) -> Column:
    """Each second bit of a bigint, from the lowest, together."""
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def geohash_cell(code: Column) -> Column:
    """Struct lat, lon of the centre of a geohash of 1 to 18 characters; null if it has others."""
    lower = F.lower(code)
    value = lambda c: F.instr(F.lit(GEOHASH), c) - 1
    number = lambda text: F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda n, c: n * 32 + value(c))

    def split(n: Column, bits: Column) -> dict[str, Column]:
        odd = bits % 2 == 1  # the last bit is of longitude then
        even, other = _gathered(n), _gathered(F.shiftright(n, 1))
        ny = F.floor(bits / 2).cast("int")
        return {"y": F.when(odd, other).otherwise(even), "x": F.when(odd, even).otherwise(other), "ny": ny, "nx": bits - ny}

    first = lambda s: struct(**split(s["n"], s["bits"]), rest=s["rest"], more=s["more"])

    def joined(s: Column) -> Column:
        low = split(s["rest"], s["more"])
        up = lambda k, bits, part: F.call_function("shiftleft", k, bits) + part
        return struct(y=up(s["y"], low["ny"], low["y"]), x=up(s["x"], low["nx"], low["x"]), ny=s["ny"] + low["ny"], nx=s["nx"] + low["nx"])

    place = lambda k, n, size: (k + 0.5) * size / F.pow(F.lit(2.0), n) - size / 2
    centre = lambda s: struct(lat=place(s["y"], s["ny"], 180.0), lon=place(s["x"], s["nx"], 360.0))
    size = lambda text: (F.length(text) * 5).cast("int")
    head, tail = F.substring(lower, 1, 12), F.substring(lower, 13, 6)
    parts = struct(n=number(head), bits=size(head), rest=number(tail), more=size(tail))
    return F.when(lower.rlike(f"^[{GEOHASH}]{{1,18}}$"), bind(parts, first, joined, centre))


def gars(lat: Column, lon: Column, precision: int = 2) -> Column:
    """Code of a cell of 30 (precision 0), 15 (1) or 5 (2) minutes."""
    x, y = F.floor(_east(lon) * 12).cast("bigint"), F.least(F.floor((lat + 90) * 12), F.lit(2159)).cast("bigint")
    ilon, ilat = F.floor(x / 6), F.floor(y / 6)
    code = F.concat(F.lpad((ilon + 1).cast("string"), 3, "0"), _letter(GARS, F.floor(ilat / 24)), _letter(GARS, ilat % 24))
    if precision > 0:
        fx, fy = x % 6, y % 6
        code = F.concat(code, (2 * (1 - F.floor(fy / 3)) + F.floor(fx / 3) + 1).cast("int").cast("string"))
        if precision > 1:
            code = F.concat(code, (3 * (2 - fy % 3) + fx % 3 + 1).cast("int").cast("string"))
    return F.when(_good(lat, lon), code)


def georef(lat: Column, lon: Column, precision: int = 2) -> Column:
    """World geographic reference: tiles of 15 degrees (0), degrees (1), then minutes with ``precision`` digits (2 to 11)."""
    unit = 60 * 10 ** max(0, precision - 2)
    x, y = F.floor(_east(lon) * unit).cast("bigint"), F.least(F.floor((lat + 90) * unit), F.lit(180 * unit - 1)).cast("bigint")
    dx, dy = F.floor(x / unit), F.floor(y / unit)
    code = F.concat(_letter(GEOREF, F.floor(dx / 15)), _letter(GEOREF, F.floor(dy / 15)))
    if precision > 0:
        code = F.concat(code, _letter(GEOREF, dx % 15), _letter(GEOREF, dy % 15))
    if precision > 1:
        code = F.concat(code, F.lpad((x % unit).cast("string"), precision, "0"), F.lpad((y % unit).cast("string"), precision, "0"))
    return F.when(_good(lat, lon), code)


def geohash_resolution(length: int) -> tuple[float, float]:
    """Degrees of latitude and of longitude of a cell."""
    return 180.0 * 2.0 ** -(5 * length // 2), 360.0 * 2.0 ** -(5 * length - 5 * length // 2)


def geohash_length(resolution: float, lon_resolution: float | None = None) -> int:
    """The least length, 18 at most, whose cells are no larger than that."""
    lon = resolution if lon_resolution is None else lon_resolution
    return next((n for n in range(18) if geohash_resolution(n)[0] <= abs(resolution) and geohash_resolution(n)[1] <= abs(lon)), 18)


def geohash_digits(length: int) -> int:
    """Decimals of a degree that a geohash of that length stands for."""
    return -math.floor(math.log10(geohash_resolution(length)[0]) + 1e-12) - 1


def gars_resolution(precision: int) -> float:
    return (1 / 2, 1 / 4, 1 / 12)[max(0, min(2, precision))]


def gars_precision(resolution: float) -> int:
    return next((p for p in range(2) if gars_resolution(p) <= abs(resolution)), 2)


def georef_resolution(precision: int) -> float:
    return (15.0, 1.0)[max(0, precision)] if precision < 2 else 1 / (60 * 10.0 ** (min(precision, 11) - 2))


def georef_precision(resolution: float) -> int:
    return next((p for p in range(11) if georef_resolution(p) <= abs(resolution)), 11)


def gars_reverse(code: Column, centre: bool = True) -> Column:
    """Struct lat, lon, precision of the centre, or the south-west corner, of a code's cell; null if the text is none."""
    upper = F.upper(code)
    part = lambda k: F.regexp_extract(upper, f"^([0-9]{{3}})([{GARS}])([{GARS}])([1-4]?)([1-9]?)$", k)
    at = lambda k: F.instr(F.lit(GARS), part(k)) - 1
    band, precision = part(1).try_cast("int") - 1, F.length(part(4)) + F.length(part(5))
    row = at(2) * 24 + at(3)
    quadrant, key = part(4).try_cast("int") - 1, part(5).try_cast("int") - 1
    unit = F.when(precision == 0, 0.5).when(precision == 1, 0.25).otherwise(1 / 12)
    deep = lambda q, k, c: F.when(precision > 0, q * 0.25).otherwise(0.0) + F.when(precision > 1, k / 12).otherwise(0.0) + (unit / 2 if c else F.lit(0.0))
    lat = row / 2 - 90 + deep(1 - F.floor(quadrant / 2), 2 - F.floor(key / 3), centre)
    lon = band / 2 - 180 + deep(quadrant % 2, key % 3, centre)
    return F.when((part(1) != "") & band.between(0, 719) & (row < 360), F.struct(lat.alias("lat"), lon.alias("lon"), precision.alias("precision")))


def georef_reverse(code: Column, centre: bool = True) -> Column:
    """Struct lat, lon, precision (see ``georef``) of the centre, or the south-west corner, of a code's cell; null if the text is none."""
    upper = F.upper(code)
    part = lambda k: F.regexp_extract(upper, f"^([{GEOREF}])([A-M])(?:([A-HJ-NPQ])([A-HJ-NPQ])((?:[0-9][0-9]){{0,11}}))?$", k)
    at = lambda k: F.instr(F.lit(GEOREF), part(k)) - 1
    half = (F.length(part(5)) / 2).cast("int")
    precision = F.when(part(3) == "", 0).when(half == 0, 1).otherwise(half)
    number = lambda k: F.substring(part(5), k, half).try_cast("bigint")
    unit = F.when(precision == 0, 15.0).when(precision == 1, 1.0).otherwise(F.lit(1.0) / (60 * F.pow(F.lit(10.0), precision - 2)))
    degree = lambda big, small: at(big) * 15 + F.when(precision > 0, at(small)).otherwise(0)
    more = lambda k: F.when(precision > 1, number(k) * unit).otherwise(0.0) + (unit / 2 if centre else F.lit(0.0))
    good = (part(1) != "") & (half != 1) & ((precision < 2) | (F.greatest(F.substring(part(5), F.lit(1), F.lit(2)), F.substring(part(5), half + 1, F.lit(2))) < "60"))
    return F.when(good, F.struct((degree(2, 4) + more(half + 1) - 90).alias("lat"), (degree(1, 3) + more(F.lit(1)) - 180).alias("lon"), precision.alias("precision")))


def utm_zone(lat: Column, lon: Column) -> Column:
    """Standard zone, 1 to 60, with the exceptions of Norway and Svalbard; 0 (polar) outside [-80, 84)."""

    def zone(s: Column) -> Column:
        x = F.when(s["x"] == 180, F.lit(-180)).otherwise(s["x"]).cast("int")
        plain = F.floor((x + 186) / 6).cast("int")
        norway = (F.floor((F.floor(s["lat"]) + 80) / 8) == 17) & (plain == 31) & (x >= 3)
        svalbard = (s["lat"] >= 72) & (x >= 0) & (x < 42)
        plain = F.when(norway, F.lit(32)).when(svalbard, (2 * F.floor((x + 183) / 12) + 1).cast("int")).otherwise(plain)
        return F.when((s["lat"] >= -80) & (s["lat"] < 84), plain).otherwise(F.lit(0))

    return F.when(_good(lat, lon), bind(struct(lat=lat, x=F.floor(ang_normalize(lon))), zone))


def epsg(zone: Column, north: Column) -> Column:
    """EPSG number of a UTM zone, or of the polar zone 0."""
    return F.when(zone == 0, F.when(north, F.lit(32661)).otherwise(F.lit(32761))).when(zone.between(1, 60), F.when(north, F.lit(32600)).otherwise(F.lit(32700)) + zone)
