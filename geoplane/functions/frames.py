"""Geocentric and local frames, and auxiliary latitudes, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import cosd, sind
from .ellipsoid import WGS84, Ellipsoid


def geocentric(lat: Column, lon: Column, h: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y, z in metres."""
    s, c = sind(lat), cosd(lat)
    n = F.lit(e.a) / F.sqrt(1 - e.e2 * s * s)
    return F.struct(((n + h) * c * cosd(lon)).alias("x"), ((n + h) * c * sind(lon)).alias("y"), (((1 - e.f) ** 2 * n + h) * s).alias("z"))


def geodetic(x: Column, y: Column, z: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct lat, lon, h of a geocentric point, by two rounds of Bowring's formula (for points not near the centre)."""
    second = e.e2 / (1 - e.e2)

    def start(s: Column) -> Column:
        p = F.hypot(s["x"], s["y"])
        return F.struct(p.alias("p"), s["z"].alias("z"), F.atan2(s["y"], s["x"]).alias("lam"), F.atan2(s["z"], (1 - e.f) * p).alias("beta"), F.lit(0.0).alias("phi"))

    def round_(s: Column) -> Column:
        phi = F.atan2(s["z"] + second * e.b * F.pow(F.sin(s["beta"]), 3), s["p"] - e.e2 * e.a * F.pow(F.cos(s["beta"]), 3))
        return F.struct(s["p"].alias("p"), s["z"].alias("z"), s["lam"].alias("lam"), F.atan((1 - e.f) * F.tan(phi)).alias("beta"), phi.alias("phi"))

    def end(s: Column) -> Column:
        sp, cp = F.sin(s["phi"]), F.cos(s["phi"])
        h = s["p"] * cp + s["z"] * sp - e.a * F.sqrt(1 - e.e2 * sp * sp)
        return F.struct(F.degrees(s["phi"]).alias("lat"), F.degrees(s["lam"]).alias("lon"), h.alias("h"))

    one = F.array(F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
    for step in (start, round_, round_, end):  # an array of one row gives each step's result a name
        one = F.transform(one, step)
    return F.get(one, F.lit(0))


def local_cartesian(lat: Column, lon: Column, h: Column, lat0: float, lon0: float, h0: float, e: Ellipsoid = WGS84) -> Column:
    """Struct east, north, up in metres, about an origin."""
    p, o = geocentric(lat, lon, h, e), geocentric(F.lit(lat0), F.lit(lon0), F.lit(h0), e)
    x, y, z = p["x"] - o["x"], p["y"] - o["y"], p["z"] - o["z"]
    sp, cp, sl, cl = sind(F.lit(lat0)), cosd(F.lit(lat0)), sind(F.lit(lon0)), cosd(F.lit(lon0))
    return F.struct((-sl * x + cl * y).alias("east"), (-sp * cl * x - sp * sl * y + cp * z).alias("north"), (cp * cl * x + cp * sl * y + sp * z).alias("up"))


def local_cartesian_reverse(east: Column, north: Column, up: Column, lat0: float, lon0: float, h0: float, e: Ellipsoid = WGS84) -> Column:
    """Struct lat, lon, h of places about an origin: turned back to geocentric axes, and taken from there."""
    o = geocentric(F.lit(lat0), F.lit(lon0), F.lit(h0), e)
    sp, cp, sl, cl = sind(F.lit(lat0)), cosd(F.lit(lat0)), sind(F.lit(lon0)), cosd(F.lit(lon0))
    out = cp * up - sp * north  # away from the axis
    return geodetic(o["x"] + cl * out - sl * east, o["y"] + sl * out + cl * east, o["z"] + sp * up + cp * north, e)


def parametric_latitude(lat: Column, e: Ellipsoid = WGS84) -> Column:
    return F.degrees(F.atan2((1 - e.f) * sind(lat), cosd(lat)))


def geocentric_latitude(lat: Column, e: Ellipsoid = WGS84) -> Column:
    return F.degrees(F.atan2((1 - e.f) ** 2 * sind(lat), cosd(lat)))


def isometric_latitude(lat: Column, e: Ellipsoid = WGS84) -> Column:
    """In degrees; infinite at a pole. For an oblate ellipsoid."""
    ec = e.e2**0.5
    return F.degrees(F.asinh(sind(lat) / cosd(lat)) - ec * F.atanh(ec * sind(lat)))


def conformal_latitude(lat: Column, e: Ellipsoid = WGS84) -> Column:
    return F.degrees(F.atan(F.sinh(F.radians(isometric_latitude(lat, e)))))


def circle_radius(lat: Column, e: Ellipsoid = WGS84) -> Column:
    """Radius of a circle of latitude."""
    return e.a * cosd(lat) / F.sqrt(1 - e.e2 * sind(lat) * sind(lat))


def meridional_radius(lat: Column, e: Ellipsoid = WGS84) -> Column:
    return e.a * (1 - e.e2) / F.pow(1 - e.e2 * sind(lat) * sind(lat), 1.5)


def transverse_radius(lat: Column, e: Ellipsoid = WGS84) -> Column:
    return e.a / F.sqrt(1 - e.e2 * sind(lat) * sind(lat))
