"""Conformal and equal-area projections in closed form, as native columns. For an oblate ellipsoid.

Each takes degrees and gives a struct of metres. A null or non-finite coordinate gives null or NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import ang_diff, ang_normalize, cosd, sind
from .bound import bind, struct
from .ellipsoid import WGS84, Ellipsoid

UPS_SCALE, UPS_FALSE = 0.994, 2_000_000.0


def _t(lat: Column, e: Ellipsoid) -> Column:
    """exp of less the isometric latitude; 0 at the north pole."""
    ec = math.sqrt(e.e2)
    return F.tan(F.radians((90 - lat) / 2)) * F.exp(ec * F.atanh(ec * sind(lat)))


def _t_of(lat: float, e: Ellipsoid) -> float:
    ec = math.sqrt(e.e2)
    return math.tan(math.radians(90 - lat) / 2) * math.exp(ec * math.atanh(ec * math.sin(math.radians(lat))))


def _m_of(lat: float, e: Ellipsoid) -> float:
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - e.e2 * s * s)


def _q(s: Column, e: Ellipsoid) -> Column:
    ec = math.sqrt(e.e2)
    return (1 - e.e2) * (s / (1 - e.e2 * s * s) + F.atanh(ec * s) / ec)


def _q_of(lat: float, e: Ellipsoid) -> float:
    s, ec = math.sin(math.radians(lat)), math.sqrt(e.e2)
    return (1 - e.e2) * (s / (1 - e.e2 * s * s) + math.atanh(ec * s) / ec)


def _latitude(t: Column, e: Ellipsoid) -> Column:
    """The latitude whose ``_t`` is t; each round leaves e2 of the error."""
    ec = math.sqrt(e.e2)
    bulge = lambda s: s["psi"] + ec * F.atanh(ec * s["s"])
    start = lambda psi: struct(psi=psi, s=F.tanh(psi))
    closer = lambda s: struct(psi=s["psi"], s=F.tanh(bulge(s)))
    # the cosine's side, by asinh's argument, keeps its digits near a pole
    return bind(-F.log(F.greatest(t, F.lit(1e-300))), start, *[closer] * 8, lambda s: F.degrees(F.atan(F.sinh(bulge(s)))))


def authalic_latitude(lat: Column, e: Ellipsoid = WGS84) -> Column:
    return F.degrees(F.asin(_q(sind(lat), e) / _q_of(90.0, e)))


def mercator(lat: Column, lon: Column, lon0: float = 0.0, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y about the equator; null at a pole."""
    x = F.radians(ang_diff(F.lit(lon0), lon)) * e.a
    return F.when(F.abs(lat) < 90, F.struct(x.alias("x"), (-e.a * F.log(_t(lat, e))).alias("y")))


def mercator_reverse(x: Column, y: Column, lon0: float = 0.0, e: Ellipsoid = WGS84) -> Column:
    """Struct lat, lon."""
    return F.struct(_latitude(F.exp(-y / e.a), e).alias("lat"), ang_normalize(F.degrees(x / e.a) + lon0).alias("lon"))


def cylindrical_equal_area(lat: Column, lon: Column, lat1: float = 0.0, lon0: float = 0.0, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y, true on the parallel lat1."""
    k = _m_of(lat1, e)
    return F.struct((F.radians(ang_diff(F.lit(lon0), lon)) * (e.a * k)).alias("x"), (_q(sind(lat), e) * (e.a / (2 * k))).alias("y"))


def _polar_radius(k0: float, e: Ellipsoid) -> float:
    ec = math.sqrt(e.e2)
    return 2 * e.a * k0 / math.sqrt((1 + ec) ** (1 + ec) * (1 - ec) ** (1 - ec))


def polar_stereographic(north: Column, lat: Column, lon: Column, k0: float = UPS_SCALE, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y, gamma (convergence, degrees), k (scale) about a pole; null at the other pole."""

    def own(i: Column) -> Column:
        sign = F.when(i["north"], F.lit(1.0)).otherwise(F.lit(-1.0))
        return struct(sign=sign, lat=i["lat"] * sign, lon=i["lon"], rho=_t(i["lat"] * sign, e) * _polar_radius(k0, e))

    def placed(s: Column) -> Column:
        sine, cosine = sind(s["lat"]), cosd(s["lat"])
        k = F.when(s["lat"] == 90, F.lit(k0)).otherwise(s["rho"] / F.nullif(cosine, F.lit(0.0)) * F.sqrt(1 - e.e2 * sine * sine) / e.a)
        found = struct(x=s["rho"] * sind(s["lon"]), y=-s["sign"] * s["rho"] * cosd(s["lon"]), gamma=ang_normalize(s["sign"] * s["lon"]), k=k)
        return F.when(s["lat"] > -90, found)

    return bind(struct(north=north, lat=lat, lon=lon), own, placed)


def polar_stereographic_reverse(north: Column, x: Column, y: Column, k0: float = UPS_SCALE, e: Ellipsoid = WGS84) -> Column:
    """Struct lat, lon."""

    def placed(s: Column) -> Column:
        sign = F.when(s["north"], F.lit(1.0)).otherwise(F.lit(-1.0))
        return struct(lat=sign * s["lat"], lon=F.degrees(F.atan2(s["x"], -sign * s["y"])))

    return bind(struct(north=north, x=x, y=y, lat=_latitude(F.hypot(x, y) / _polar_radius(k0, e), e)), placed)


def ups(lat: Column, lon: Column) -> Column:
    """Struct north, easting, northing of the universal polar stereographic grid, about the nearer pole."""
    north = lat >= 0
    p = polar_stereographic(north, lat, lon)
    return F.struct(north.alias("north"), (p["x"] + UPS_FALSE).alias("easting"), (p["y"] + UPS_FALSE).alias("northing"))


def _conic(rho: Column, rho0: float, n: float, lam: Column) -> tuple[Column, Column]:
    turn = F.radians(lam * n)
    return rho * F.sin(turn), rho0 - rho * F.cos(turn)


def _lambert(lat1: float, lat2: float, k1: float, e: Ellipsoid) -> tuple[float, float]:
    """The cone's constant, and the radius where the isometric latitude is 0."""
    if lat1 == lat2:
        n = math.sin(math.radians(lat1))
    else:
        n = math.log(_m_of(lat1, e) / _m_of(lat2, e)) / math.log(_t_of(lat1, e) / _t_of(lat2, e))
    return n, e.a * k1 * _m_of(lat1, e) / n / _t_of(lat1, e) ** n


def _albers(lat1: float, lat2: float, e: Ellipsoid) -> tuple[float, float]:
    if lat1 == lat2:
        n = math.sin(math.radians(lat1))
    else:
        n = (_m_of(lat1, e) ** 2 - _m_of(lat2, e) ** 2) / (_q_of(lat2, e) - _q_of(lat1, e))
    return n, _m_of(lat1, e) ** 2 + n * _q_of(lat1, e)


def lambert_conformal(lat: Column, lon: Column, lat1: float, lat2: float, lon0: float, k1: float = 1.0, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y, gamma, k of the conic with scale k1 on the parallels lat1 and lat2 (both on one side of the equator).

    y counts from the latitude of least scale, whose sine is the cone's constant. Null at the pole that is far away.
    """
    n, size = _lambert(lat1, lat2, k1, e)
    lam = ang_diff(F.lit(lon0), lon)
    rho = F.pow(_t(lat, e), F.lit(n)) * size
    x, y = _conic(rho, size * _t_of(math.degrees(math.asin(n)), e) ** n, n, lam)
    s, c = sind(lat), cosd(lat)
    k = F.abs(rho) * abs(n) / F.nullif(c, F.lit(0.0)) * F.sqrt(1 - e.e2 * s * s) / e.a
    return F.when(lat * math.copysign(1.0, n) > -90, F.struct(x.alias("x"), y.alias("y"), (lam * n).alias("gamma"), k.alias("k")))


def albers_equal_area(lat: Column, lon: Column, lat1: float, lat2: float, lat0: float, lon0: float, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y, gamma of the conic true on the parallels lat1 and lat2; y counts from lat0."""
    n, c = _albers(lat1, lat2, e)
    lam = ang_diff(F.lit(lon0), lon)
    rho = F.sqrt(F.greatest(c - n * _q(sind(lat), e), F.lit(0.0))) * (e.a / n)
    x, y = _conic(rho, e.a / n * math.sqrt(c - n * _q_of(lat0, e)), n, lam)
    return F.struct(x.alias("x"), y.alias("y"), (lam * n).alias("gamma"))


def _back(x: Column, y: Column, rho0: float, n: float, lon0: float) -> tuple[Column, Column]:
    """Signed radius and longitude of a point of a conic projection."""
    side = math.copysign(1.0, n)
    turn = F.atan2(x * side, (rho0 - y) * side)
    return F.hypot(x, rho0 - y) * side, ang_normalize(F.degrees(turn) / n + lon0)


def lambert_conformal_reverse(x: Column, y: Column, lat1: float, lat2: float, lon0: float, k1: float = 1.0, e: Ellipsoid = WGS84) -> Column:
    """Struct lat, lon of a point of ``lambert_conformal``."""
    n, size = _lambert(lat1, lat2, k1, e)
    rho, lon = _back(x, y, size * _t_of(math.degrees(math.asin(n)), e) ** n, n, lon0)
    return bind(struct(rho=rho, lon=lon), lambda s: struct(lat=_latitude(F.pow(s["rho"] / size, F.lit(1 / n)), e), lon=s["lon"]))


def _closer(e: Ellipsoid):
    """A step of Newton's method on the sine of a latitude whose ``_q`` is known."""

    def step(s: Column) -> Column:
        w = 1 - e.e2 * s["s"] * s["s"]
        sine = s["s"] + (s["q"] - _q(s["s"], e)) * w * w / (2 * (1 - e.e2))
        return struct(q=s["q"], lon=s["lon"], s=F.greatest(F.least(sine, F.lit(1.0)), F.lit(-1.0)))

    return step


def _of_q(q: Column, lon: Column, e: Ellipsoid) -> Column:
    start = lambda s: struct(q=s["q"], lon=s["lon"], s=F.greatest(F.least(s["q"] / 2, F.lit(1.0)), F.lit(-1.0)))
    return bind(struct(q=q, lon=lon), start, *[_closer(e)] * 6, lambda s: struct(lat=F.degrees(F.asin(s["s"])), lon=s["lon"]))


def albers_equal_area_reverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float, lon0: float, e: Ellipsoid = WGS84) -> Column:
    """Struct lat, lon of a point of ``albers_equal_area``."""
    n, c = _albers(lat1, lat2, e)
    rho, lon = _back(x, y, e.a / n * math.sqrt(c - n * _q_of(lat0, e)), n, lon0)
    return _of_q((c - F.pow(rho * (n / e.a), F.lit(2.0))) / n, lon, e)


def cylindrical_equal_area_reverse(x: Column, y: Column, lat1: float = 0.0, lon0: float = 0.0, e: Ellipsoid = WGS84) -> Column:
    """Struct lat, lon of a point of ``cylindrical_equal_area``."""
    k = _m_of(lat1, e)
    return _of_q(y * (2 * k / e.a), ang_normalize(F.degrees(x / (e.a * k)) + lon0), e)
