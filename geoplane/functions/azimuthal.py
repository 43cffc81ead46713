"""NumPy kernels for projections by geodesics from a centre: azimuthal equidistant, gnomonic, Cassini-Soldner. Degrees and metres."""

from __future__ import annotations

import numpy as np

from .ellipsoid import WGS84, Ellipsoid
from .geodesic import _columns, difference, direct, inverse, normalized, sincosd
from .rhumb import meridian


def equidistant(lat0, lon0, lat, lon, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """x, y, azi (of the geodesic at the point), rk (reciprocal of the scale across it)."""
    g = inverse(lat0, lon0, lat, lon, e, ("s12", "azi1", "azi2", "m12"))
    s, c = sincosd(g["azi1"])
    near = g["s12"] < 1e-5
    return {"x": g["s12"] * s, "y": g["s12"] * c, "azi": g["azi2"], "rk": np.where(near, 1.0, g["m12"] / np.where(near, 1.0, g["s12"]))}


def equidistant_reverse(lat0, lon0, x, y, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """lat, lon, azi, rk."""
    lat0, lon0, x, y = _columns(lat0, lon0, x, y)
    s12 = np.hypot(x, y)
    d = direct(lat0, lon0, np.degrees(np.arctan2(x, y)), s12, e, fields=("lat2", "lon2", "azi2", "m12"))
    near = s12 < 1e-5
    return {"lat": d["lat2"], "lon": d["lon2"], "azi": d["azi2"], "rk": np.where(near, 1.0, d["m12"] / np.where(near, 1.0, s12))}


def gnomonic(lat0, lon0, lat, lon, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """x, y, azi, rk: geodesics are nearly straight lines. x and y are NaN beyond the horizon."""
    g = inverse(lat0, lon0, lat, lon, e, ("azi1", "azi2", "m12", "scale12"))
    s, c = sincosd(g["azi1"])
    rho = np.where(g["scale12"] > 0, g["m12"] / np.where(g["scale12"] > 0, g["scale12"], 1.0), np.nan)
    return {"x": rho * s, "y": rho * c, "azi": g["azi2"], "rk": g["scale12"]}


def gnomonic_reverse(lat0, lon0, x, y, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """lat, lon, azi, rk, by Newton's method on the distance whose reduced length over scale is the radius."""
    lat0, lon0, x, y = _columns(lat0, lon0, x, y)
    rho, azi0 = np.hypot(x, y), np.degrees(np.arctan2(x, y))
    s = e.a * np.arctan(rho / e.a)
    for _ in range(12):
        d = direct(lat0, lon0, azi0, s, e, fields=("m12", "scale12"))
        m, scale = d["m12"], d["scale12"]
        far = rho > e.a  # there the reciprocal is nearer to a straight line
        step = np.where(far, (scale / np.where(m == 0, 1, m) - 1 / np.where(rho == 0, 1, rho)) * m * m, (rho - m / scale) * scale * scale)
        s = np.clip(s + step, 0, np.pi * e.a)
    d = direct(lat0, lon0, azi0, s, e, fields=("lat2", "lon2", "azi2", "scale12"))
    return {"lat": d["lat2"], "lon": d["lon2"], "azi": d["azi2"], "rk": d["scale12"]}


def cassini(lat0, lon0, lat, lon, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """x, y, azi (of the x axis' geodesic at the point), rk (reciprocal of the northing's scale).

    x is the length of the geodesic from the central meridian that meets it at a right angle, y the place on the
    meridian where it does. By symmetry that geodesic is half of the one to the mirror image.
    """
    lat0, lon0, lat, lon = _columns(lat0, lon0, lat, lon)
    off = difference(lon0, lon)
    g = inverse(lat, -np.abs(off), lat, np.abs(off), e, ("s12", "azi1"))
    half = direct(lat, -np.abs(off), g["azi1"], g["s12"] / 2, e, fields=("lat2",))["lat2"]
    there = g["s12"] == 0
    behind = np.abs(off) > 90
    foot = np.where(there, lat, half)
    along = np.where(behind, np.copysign(180.0, lat) - foot, foot)
    x = np.copysign(g["s12"] / 2, off)
    side = np.where(np.signbit(off), -1.0, 1.0)
    back = direct(foot, np.where(behind, 180.0, 0.0), 90.0 * np.where(behind, -side, side), g["s12"] / 2, e, fields=("azi2", "scale12"))
    azi = normalized(back["azi2"] + np.where(side < 0, 180.0, 0.0))
    return {"x": x, "y": meridian(lat0, along, e), "azi": azi, "rk": back["scale12"]}


def cassini_reverse(lat0, lon0, x, y, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """lat, lon, azi, rk."""
    lat0, lon0, x, y = _columns(lat0, lon0, x, y)
    foot = direct(lat0, lon0, np.zeros_like(lat0), y, e, fields=("lat2", "lon2", "azi2"))
    d = direct(foot["lat2"], foot["lon2"], foot["azi2"] + 90, x, e, fields=("lat2", "lon2", "azi2", "scale12"))
    return {"lat": d["lat2"], "lon": d["lon2"], "azi": d["azi2"], "rk": d["scale12"]}
