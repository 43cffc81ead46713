"""Numbers, dates and angles as text, in native columns. Text that is none gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import ang_normalize
from .bound import bind, struct


def is_negative(x: Column) -> Column:
    """Below zero, or -0."""
    return (x < 0) | ((x == 0) & x.cast("string").startswith("-"))


def number_text(x: Column, digits: int = 6) -> Column:
    """Fixed-point text of the double as it is, halves to even; ``nan``, ``inf``, ``-inf``.

    What multiplying by a power of ten leaves out is reckoned too, so 60.45, which is a little more as a double, is
    60.5 and 0.25, which is just that, is 0.2.
    """
    scale, cut = 10.0**digits, 134217729.0  # 2 ** 27 + 1 parts a double in halves
    high = cut * scale - (cut * scale - scale)
    halves = lambda v: struct(x=v, y=v * scale, high=cut * v - (cut * v - v))

    def left(s: Column) -> Column:
        low = s["x"] - s["high"]
        return struct(x=s["x"], y=s["y"], floor=F.floor(s["y"]).cast("double"), left=((s["high"] * high - s["y"]) + s["high"] * (scale - high) + low * high) + low * (scale - high))

    def rounded(s: Column) -> Column:
        rest = s["y"] - s["floor"]
        up = (rest > 0.5) | ((rest == 0.5) & ((s["left"] > 0) | ((s["left"] == 0) & (s["floor"] % 2 == 1))))
        number = (s["floor"] + F.when(up, 1.0).otherwise(0.0)).cast("decimal(38,0)").cast("string")
        return struct(x=s["x"], number=F.when(F.length(number) <= digits, F.lpad(number, digits + 1, "0")).otherwise(number))

    def pointed(s: Column) -> Column:
        whole = F.length(s["number"]) - digits
        text = F.concat(F.substring(s["number"], F.lit(1), whole), F.lit("."), F.substring(s["number"], whole + 1, F.lit(digits))) if digits else s["number"]
        return F.when(s["x"] < 1e15 / scale, text).otherwise(F.format_string(f"%.{digits}f", s["x"]))

    signed = F.concat(F.when(is_negative(x), "-").otherwise(""), bind(F.when(F.abs(x) < float("inf"), F.abs(x)).otherwise(0.0), halves, left, rounded, pointed))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x.isNotNull(), signed)


def number_of(text: Column) -> Column:
    """The double that a text is, white space around it apart; also nan and inf, in any case."""
    t = F.lower(F.trim(text))
    special = F.when(t.rlike(r"^[-+]?nan$"), F.lit(float("nan"))).when(t.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(t.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
    return F.coalesce(special, F.when(t.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[-+]?[0-9]+)?$"), t.try_cast("double")))


def fraction_of(text: Column) -> Column:
    """The same, also of fractions such as ``1/298.25``."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, number_of(parts[0]) / F.nullif(number_of(parts[1]), F.lit(0.0))).otherwise(number_of(text))


# Days are counted from 1 January of the year 1, by the Julian calendar up to 2 September 1752 and the Gregorian from 14 September on.
#: The first Gregorian date, its number, and four years of the Gregorian calendar that go like any four of the Julian one.
SWITCH, SWITCH_NUMBER = "1752-09-14", 639799
FOUR_YEARS, FOUR_DAYS = 2001, 1461


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")


def day_number(y: Column, m: Column, d: Column) -> Column:
    """The number of a date; null if there is no such date. Spark's dates count the Gregorian days; a Julian date is counted in four years that have its form."""

    def number(s: Column) -> Column:
        gregorian = SWITCH_NUMBER + F.date_diff(_date(s["y"], s["m"], s["d"]), F.lit(SWITCH).cast("date"))
        before = F.floor((s["y"] - 1) / 4).cast("int")
        julian = before * FOUR_DAYS + 1 + F.date_diff(_date(s["y"] - 4 * before + FOUR_YEARS - 1, s["m"], s["d"]), F.lit(f"{FOUR_YEARS}-01-01").cast("date"))
        n = F.when(F.struct(s["y"], s["m"], s["d"]) >= F.struct(F.lit(1752), F.lit(9), F.lit(14)), gregorian).when(julian < SWITCH_NUMBER, julian)
        return F.when((n > 0) & (s["y"] > 0), n)

    return bind(struct(y=y.cast("int"), m=m.cast("int"), d=d.cast("int")), number)


def date_of(n: Column) -> Column:
    """Struct y, m, d of a day's number."""

    def dated(s: Column) -> Column:
        late = s["n"] >= SWITCH_NUMBER
        before = F.floor((s["n"] - 1) / FOUR_DAYS).cast("int")
        date = F.when(late, F.date_add(F.lit(SWITCH).cast("date"), s["n"] - SWITCH_NUMBER)).otherwise(F.date_add(F.lit(f"{FOUR_YEARS}-01-01").cast("date"), s["n"] - 1 - before * FOUR_DAYS))
        return struct(date=date, more=F.when(late, 0).otherwise(4 * before + 1 - FOUR_YEARS))

    parts = lambda s: struct(y=F.year(s["date"]) + s["more"], m=F.month(s["date"]), d=F.dayofmonth(s["date"]))
    return bind(struct(n=n.cast("int")), dated, parts)


def weekday(n: Column) -> Column:
    """0 for Sunday to 6; the first day was a Saturday."""
    return (n + 5) % 7


def date_parts(text: Column) -> Column:
    """Struct y, m, d of ``2010``, ``2010-03`` or ``2010-03-05``; parts that are left out are 1."""
    part = lambda k: F.regexp_extract(text, "^([0-9]+)(?:-([0-9]+))?(?:-([0-9]+))?$", k)
    number = lambda k: F.when(part(k) == "", 1).otherwise(part(k).try_cast("int"))
    return F.when(part(1) != "", struct(y=part(1).try_cast("int"), m=number(2), d=number(3)))


def fractional_year(text: Column) -> Column:
    """A year as a number: ``2010.25`` as it is, a date by its place in the year."""

    def placed(s: Column) -> Column:
        first = day_number(s["y"], F.lit(1), F.lit(1))
        return s["y"] + (day_number(s["y"], s["m"], s["d"]) - first) / (day_number(s["y"] + 1, F.lit(1), F.lit(1)) - first)

    return F.coalesce(F.when(~F.trim(text).rlike("^[0-9]+$"), number_of(text)), bind(date_parts(F.trim(text)), placed))


# Characters that stand for degrees, minutes, seconds, signs, and those that are left out.
DEGREES, MINUTES, SECONDS = "°º˚⁰∘*", "′‵´’‘‛`ʹ", "″‶˝”“‟ʺ"
PLUS, MINUS, NOTHING = "➕⁤", "‐‑–—−➖", "    ​ ⁣"
KINDS = {"none": 0, "latitude": 2, "longitude": 3, "azimuth": 3}


def dms_text(x: Column, trailing: int = 2, digits: int = 0, kind: str = "none", separator: str = "") -> Column:
    """Degrees, and with ``trailing`` 1 or 2 minutes and seconds, the last with so many digits: ``-1d02'03"``, ``01d02'03"S``.

    ``kind``: none (with a sign), latitude, longitude (with letters), azimuth (0 to 360). ``separator``: put instead of d and ', nothing at the end.
    """
    digits = min(15 - 2 * trailing, digits)
    if kind == "azimuth":
        x = bind(ang_normalize(x), lambda a: F.when(a < 0, a + 360).otherwise(a + 0.0))
    scale = 60**trailing
    ends = {"latitude": "SN", "longitude": "WE"}.get(kind)

    def split(s: Column) -> Column:
        size = F.abs(s["x"])
        whole = F.floor(size).cast("decimal(38,0)") if trailing else F.lit(0).cast("decimal(38,0)")
        rest = number_text((size - whole.cast("double")) * scale if trailing else size, digits)
        return struct(negative=is_negative(s["x"]), whole=whole, number=F.split(rest, r"\.")[0].cast("decimal(38,0)"), decimals=F.regexp_extract(rest, r"(\..*)$", 1))

    def written(s: Column) -> Column:
        unit = lambda v, width: F.when(F.length(v.cast("string")) < width, F.lpad(v.cast("string"), width, "0")).otherwise(v.cast("string"))
        degree = s["whole"] + F.floor(s["number"] / scale).cast("decimal(38,0)") if trailing else s["number"]
        minute = F.floor(s["number"] % scale / (60 if trailing == 2 else 1)).cast("int")
        second = (s["number"] % 60).cast("int")
        marks = (separator, separator, "") if separator else ("d", "'", '"')
        parts = [unit(degree, KINDS[kind])]
        if trailing == 0:
            parts.append(s["decimals"])
        else:
            parts += [F.lit(marks[0]), unit(minute, 2)] + ([s["decimals"], F.lit("" if separator else "'")] if trailing == 1 else [F.lit(marks[1]), unit(second, 2), s["decimals"], F.lit(marks[2])])
        text = F.concat(*parts)
        if ends:
            return F.concat(text, F.when(s["negative"], ends[0]).otherwise(ends[1]))
        return F.concat(F.when(s["negative"], "-").otherwise(""), text) if kind == "none" else text

    found = bind(struct(x=x), split, written)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), number_text(x, 0)).otherwise(found)


_NUMBER = r"([0-9]+\.?[0-9]*|\.[0-9]+)"


def dms_value(text: Column) -> Column:
    """Struct value, kind (latitude, longitude, none) of an angle: ``40d38'23"N``, ``40:38:23``, ``-73.5``, sums such as ``20:30+1:30``, nan, inf."""
    clean = F.upper(text)
    for letters, to in ((DEGREES, "D"), (MINUTES, "'"), (SECONDS, '"'), (PLUS, "+"), (MINUS, "-")):
        clean = F.translate(clean, letters, to * len(letters))
    clean = F.trim(F.regexp_replace(F.translate(clean, NOTHING, ""), "''", '"'))
    pattern = rf"^([NSEW]?)([-+]?)(?:{_NUMBER}(?:[D:]|$|(?=[NSEW]$)))?(?:{_NUMBER}(?:[':]|$|(?=[NSEW]$)))?(?:{_NUMBER}(?:\"|$|(?=[NSEW]$)))?([NSEW]?)$"

    def read(piece: Column) -> Column:
        part = lambda k: F.regexp_extract(piece, pattern, k)
        d, m, s = (part(k) for k in (3, 4, 5))
        number = lambda t: F.when(t == "", 0.0).otherwise(t.try_cast("double"))
        letter = F.concat(part(1), part(6))
        early_point = (d.contains(".") & ((m != "") | (s != ""))) | (m.contains(".") & (s != ""))
        good = piece.rlike(pattern) & ((d != "") | (m != "") | (s != "")) & (F.length(letter) < 2) & ~early_point & ~piece.rlike(":[NSEW]?$") & (number(m) < 60) & (number(s) < 60)
        size = F.when(number(s) != 0, (60 * (60 * number(d) + number(m)) + number(s)) / 3600).when(number(m) != 0, (60 * number(d) + number(m)) / 60).otherwise(number(d))
        sign = F.when((part(2) == "-") != letter.isin("S", "W"), -1.0).otherwise(1.0)
        kind = F.when(letter.isin("N", "S"), "latitude").when(letter.isin("E", "W"), "longitude").otherwise("none")
        return F.when(good, struct(value=sign * size, kind=kind))

    def summed(pieces: Column) -> Column:
        kinds = F.array_distinct(F.filter(F.transform(pieces, lambda p: p["kind"]), lambda k: k != "none"))
        total = F.aggregate(pieces, F.lit(-0.0), lambda a, p: a + p["value"])
        return F.when(~F.exists(pieces, lambda p: p.isNull()) & (F.size(kinds) < 2), struct(value=total, kind=F.coalesce(F.get(kinds, F.lit(0)), F.lit("none"))))

    pieces = F.split(F.regexp_replace(clean, r"(?<!^)(?<!^[NSEW])([-+])", "\u0001$1"), "\u0001")
    special = F.when(clean.rlike("^[-+]?(NAN|INF)$"), struct(value=number_of(clean), kind=F.lit("none")))
    return F.coalesce(special, bind(F.transform(pieces, read), summed))


def lat_lon(one: Column, two: Column, long_first: bool = False) -> Column:
    """Struct lat, lon of two angles' texts, in either order if letters tell; null if both are of one kind, or the latitude is beyond a pole."""

    def paired(s: Column) -> Column:
        a, b = s["a"]["kind"], s["b"]["kind"]
        swapped = F.when((a == "none") & (b == "none"), F.lit(long_first)).when(a == "none", b == "latitude").otherwise(a == "longitude")
        lat, lon = (F.when(swapped, s[x]["value"]).otherwise(s[y]["value"]) for x, y in (("b", "a"), ("a", "b")))
        return F.when(((a != b) | (a == "none")) & s["a"].isNotNull() & s["b"].isNotNull(), struct(lat=lat, lon=lon))

    legal = lambda p: F.when((F.abs(p["lat"]) <= 90) | F.isnan(p["lat"]), p)
    return bind(struct(a=dms_value(one), b=dms_value(two)), paired, legal)


def arc_angle(text: Column) -> Column:
    """An angle without a letter."""
    return bind(dms_value(text), lambda v: F.when(v["kind"] == "none", v["value"]))


def azimuth(text: Column) -> Column:
    """An angle in [-180, 180], with E or W if any letter."""
    return bind(dms_value(text), lambda v: F.when(v["kind"] != "latitude", ang_normalize(v["value"])))
