"""Angles as columns that keep their turns and quadrants: struct (s, c, n), sine, cosine and whole turns; and auxiliary angles (y, x), which keep a size too.

Zeros have signs: s = -0, c = -1 is -180 degrees. All is native; sums never leave sines and cosines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bound import bind, struct
from .text import azimuth, dms_text, dms_value, is_negative as negative, lat_lon


def signed(size: Column, like: Column) -> Column:
    """A size with the sign of another number."""
    return F.abs(size) * F.when(negative(like), -1.0).otherwise(1.0)  # two literals 0 and -0 would be taken for the same by the optimizer: sizes of zero must be columns


def _base(a: Column) -> Column:
    """Degrees in [-180, 180], by the quarter of the circle, so that multiples of 90 are exact."""
    s, c = F.abs(a["s"]), F.abs(a["c"])
    first = F.when(s > c, 90 - F.degrees(F.atan2(c, s))).otherwise(F.degrees(F.atan2(s, c)))
    return signed(F.when(negative(a["c"]), 180 - first).otherwise(first), a["s"])


def turn(degrees: Column) -> Column:
    """The angle of so many degrees: sine and cosine exact at multiples of 30 and 45; null stays null, and what is not finite is NaN."""

    def reduced(v: Column) -> Column:
        quarter = F.rint((v["d"] % 360) / 90)
        return struct(d=v["d"], q=F.pmod(quarter.cast("int"), F.lit(4)), r=v["d"] % 360 - 90 * quarter)

    def sides(v: Column) -> Column:
        r, x = F.abs(v["r"]), F.radians(v["r"])
        sine = F.when(r == 30, signed(F.lit(0.5), v["r"])).when(r == 45, signed(F.lit(0.5**0.5), v["r"])).otherwise(F.sin(x))
        cosine = F.when(r == 45, F.lit(0.5**0.5)).when(r == 30, F.lit(0.75**0.5)).otherwise(F.cos(x))
        return struct(d=v["d"], q=v["q"], x=sine, y=cosine)

    def placed(v: Column) -> Column:
        s = F.when(v["q"] == 0, v["x"]).when(v["q"] == 1, v["y"]).when(v["q"] == 2, -v["x"]).otherwise(-v["y"])
        c = F.when(v["q"] == 0, v["y"]).when(v["q"] == 1, -v["x"]).when(v["q"] == 2, -v["y"]).otherwise(v["x"])
        return struct(d=v["d"], s=F.when(s == 0, signed(s, v["d"])).otherwise(s), c=c + 0.0)

    counted = lambda v: struct(s=v["s"], c=v["c"], n=F.rint((v["d"] - _base(v)) / 360) + 0.0)
    finite = F.when(F.abs(degrees) < float("inf"), degrees).otherwise(F.lit(float("nan")))
    bad = struct(s=F.lit(float("nan")), c=F.lit(float("nan")), n=F.lit(float("nan")))
    return F.when(degrees.isNull(), F.lit(None)).when(F.isnan(finite), bad).otherwise(bind(struct(d=finite.cast("double")), reduced, sides, placed, counted))


def of_sides(s: Column, c: Column, n: Column | float = 0.0) -> Column:
    """The angle of a right triangle's sides, made unit, with so many turns."""
    h = F.hypot(s, c)
    return struct(s=s / F.nullif(h, F.lit(0.0)), c=c / F.nullif(h, F.lit(0.0)), n=F.rint(n if isinstance(n, Column) else F.lit(n)))


def degrees(a: Column) -> Column:
    return bind(a, lambda v: F.when(v["n"] == 0, _base(v)).otherwise(_base(v) + 360 * v["n"]))


def radians(a: Column) -> Column:
    return F.radians(degrees(a))


def base(a: Column) -> Column:
    """Without its turns."""
    return bind(a, lambda v: struct(s=v["s"], c=v["c"], n=F.lit(0.0)))


def minus(a: Column) -> Column:
    return bind(a, lambda v: struct(s=v["s"] * -1.0, c=v["c"], n=0.0 - v["n"]))


def plus(a: Column, b: Column) -> Column:
    """The sum, by the theorem of sines and cosines; turns are carried. A zero angle changes no sign."""

    def added(v: Column) -> Column:
        a, b = v["a"], v["b"]
        return struct(a=a, b=b, s=a["s"] * b["c"] + a["c"] * b["s"], c=a["c"] * b["c"] - a["s"] * b["s"])

    def carried(v: Column) -> Column:
        a, b = v["a"], v["b"]
        carry = F.rint((_base(a) + _base(b) - _base(v)) / 360)
        none = lambda x: (x["s"] == 0) & (x["c"] > 0)
        whole = struct(s=v["s"], c=v["c"] + 0.0, n=a["n"] + b["n"] + carry)
        keep = lambda x: struct(s=x["s"], c=x["c"], n=a["n"] + b["n"])
        return F.when(none(b), keep(a)).when(none(a), keep(b)).otherwise(whole)

    return bind(struct(a=a, b=b), added, carried)


def less(a: Column, b: Column) -> Column:
    """a - b."""
    return plus(a, minus(b))


def rebase(a: Column, centre: Column) -> Column:
    """The same direction, within half a turn of ``centre``."""
    return plus(base(less(a, centre)), centre)


def quadrant(a: Column) -> Column:
    """0 to 3, by the signs: zeros count by theirs."""
    return bind(a, lambda v: F.when(negative(v["s"]), F.when(negative(v["c"]), 2).otherwise(3)).otherwise(F.when(negative(v["c"]), 1).otherwise(0)))


def with_quadrant(a: Column, q: Column) -> Column:
    """The sizes of sine and cosine in another quadrant."""
    side = lambda size, minus: F.abs(size) * F.when(minus, -1.0).otherwise(1.0)
    return bind(struct(a=a, q=q), lambda v: struct(s=side(v["a"]["s"], v["q"] >= 2), c=side(v["a"]["c"], v["q"].isin(1, 2)), n=v["a"]["n"]))


def quarters(a: Column) -> Column:
    """How many right angles the nearest multiple of 90 degrees is."""
    return bind(a, lambda v: 4 * v["n"] + F.rint(_base(v) / 90))


def cardinal(q: Column) -> Column:
    """The angle of so many right angles."""
    return turn(F.rint(q) * 90)


def nearest(a: Column) -> Column:
    """The nearest multiple of 90 degrees."""

    def taken(v: Column) -> Column:
        level = F.abs(v["c"]) >= F.abs(v["s"])
        return struct(s=F.when(level, signed(v["s"] * 0.0, v["s"])).otherwise(signed(F.lit(1.0), v["s"])), c=F.when(level, signed(F.lit(1.0), v["c"])).otherwise(signed(v["c"] * 0.0, v["c"])), n=v["n"])

    return bind(a, taken)


def reflect(a: Column, flip_s: bool = False, flip_c: bool = False, swap: bool = False) -> Column:
    """Sine or cosine turned round, then swapped."""

    def turned(v: Column) -> Column:
        s, c = v["s"] * -1.0 if flip_s else v["s"], v["c"] * -1.0 if flip_c else v["c"]
        return struct(s=c if swap else s, c=s if swap else c, n=v["n"])

    return bind(a, turned)


def stretched(a: Column, m: Column) -> Column:
    """The angle in the same quadrant with m times the tangent; m >= 0."""
    return bind(struct(a=a, m=m), lambda v: of_sides(v["a"]["s"] * F.least(v["m"], F.lit(1.0)), v["a"]["c"] / F.greatest(v["m"], F.lit(1.0)), v["a"]["n"]))


def of_text(text: Column) -> Column:
    """The angle that a text gives; null if it is none."""
    return turn(dms_value(text)["value"])


def of_azimuth(text: Column) -> Column:
    """An azimuth's angle; null if the text is none, or has N or S."""
    return turn(azimuth(text))


def of_lat_lon(a: Column, b: Column) -> Column:
    """Struct lat, lon of angles, of two texts in either order; null if they don't make a place."""
    return bind(lat_lon(a, b), lambda v: F.when(v.isNotNull(), struct(lat=turn(v["lat"]), lon=turn(v["lon"]))))


def lat_lon_text(lat: Column, lon: Column, digits: int = 3) -> Column:
    """Both as one text, to seconds."""
    return F.concat(dms_text(degrees(lat), 2, digits, "latitude"), F.lit(" "), dms_text(degrees(lon), 2, digits, "longitude"))


def auxiliary(y: Column, x: Column) -> Column:
    """An auxiliary angle: its tangent is y / x, and neither is reduced."""
    return struct(y=y, x=x)


def auxiliary_of(degrees: Column) -> Column:
    return bind(turn(degrees), lambda v: struct(y=v["s"], x=v["c"]))


def tangent(a: Column) -> Column:
    """y / x: infinite where x is 0 and y isn't, NaN where both are."""
    return bind(a, lambda v: F.when(v["x"] != 0, v["y"] / F.nullif(v["x"], F.lit(0.0))).when(v["y"] == 0, F.lit(float("nan"))).otherwise(signed(F.lit(float("inf")), F.when(negative(v["x"]), v["y"] * -1.0).otherwise(v["y"]))))


def auxiliary_degrees(a: Column) -> Column:
    return bind(a, lambda v: _base(struct(s=v["y"], c=v["x"])))


def normalized(a: Column) -> Column:
    """With y and x on the unit circle; NaN for (0, 0), for two infinities and for NaN."""

    def unit(v: Column) -> Column:
        infinite = lambda z: F.abs(z) == float("inf")
        r = F.hypot(v["y"], v["x"])
        bad = ((v["y"] == 0) & (v["x"] == 0)) | (infinite(v["y"]) & infinite(v["x"])) | F.isnan(v["y"]) | F.isnan(v["x"])
        part = lambda z: F.when(bad, F.lit(float("nan"))).when(infinite(z), signed(F.lit(1.0), z)).otherwise(z / F.nullif(r, F.lit(0.0)))
        return struct(y=part(v["y"]), x=part(v["x"]))

    return bind(a, unit)


def auxiliary_plus(a: Column, b: Column) -> Column:
    """The angles' sum, sizes multiplied; b of tangent 0 changes nothing, so that signs stay."""

    def added(v: Column) -> Column:
        a, b = v["a"], v["b"]
        return F.when((b["y"] == 0) & (b["x"] != 0), a).otherwise(struct(y=a["y"] * b["x"] + a["x"] * b["y"], x=a["x"] * b["x"] - a["y"] * b["y"]))

    return bind(struct(a=a, b=b), added)


def auxiliary_like(a: Column, b: Column) -> Column:
    """The sizes of a in the quadrant of b."""
    return bind(struct(a=a, b=b), lambda v: struct(y=signed(v["a"]["y"], v["b"]["y"]), x=signed(v["a"]["x"], v["b"]["x"])))
