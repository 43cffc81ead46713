"""Auxiliary latitudes and measures of an ellipsoid, on arrays. Degrees and metres."""

from __future__ import annotations

import numpy as np

from .ellipsoid import WGS84, Ellipsoid
from .geodesic import _columns, sincosd
from .rhumb import isometric, isometric_difference, meridian, sin_authalic

KINDS = ("geographic", "parametric", "geocentric", "rectifying", "conformal", "authalic")


def from_geographic(lat, kind: str, e: Ellipsoid = WGS84) -> np.ndarray:
    """The auxiliary latitude of that kind."""
    (lat,) = _columns(lat)
    s, c = sincosd(lat)
    if kind == "geographic":
        return lat
    if kind == "parametric":
        return np.degrees(np.arctan2((1 - e.f) * s, c))
    if kind == "geocentric":
        return np.degrees(np.arctan2((1 - e.f) ** 2 * s, c))
    if kind == "rectifying":
        return 90 * meridian(0 * lat, lat, e) / meridian(np.zeros(1), np.full(1, 90.0), e)
    if kind == "conformal":
        return np.where(c == 0, lat, np.degrees(np.arctan(np.sinh(isometric(lat, e)))))
    if kind == "authalic":
        # near a pole by the cosine's side: the sine has no digits left there
        q = sin_authalic(lat, e)
        return np.where(np.abs(lat) == 90, lat, np.degrees(np.arcsin(np.clip(q, -1, 1))))
    raise ValueError(kind)


def to_geographic(aux, kind: str, e: Ellipsoid = WGS84) -> np.ndarray:
    """The geographic latitude; each round leaves about the flattening of the error."""
    (aux,) = _columns(aux)
    lat = aux.copy()
    for _ in range(14):
        lat = np.clip(lat + (aux - from_geographic(lat, kind, e)), -90, 90)
    return lat


def convert(lat, one: str, other: str, e: Ellipsoid = WGS84) -> np.ndarray:
    return from_geographic(to_geographic(lat, one, e), other, e)


def divided_difference(lat1, lat2, kind: str, e: Ellipsoid = WGS84) -> np.ndarray:
    """(aux(lat2) - aux(lat1)) / (lat2 - lat1), or the slope where they are equal: for the rectifying and the isometric latitude to full accuracy."""
    lat1, lat2 = _columns(lat1, lat2)
    gap = lat2 - lat1
    same = gap == 0
    s, c = sincosd(lat1)
    w = 1 - e.e2 * s * s
    if kind == "rectifying":
        quarter = meridian(np.zeros(1), np.full(1, 90.0), e)
        return np.where(same, np.radians(e.a * (1 - e.e2)) / w**1.5, meridian(lat1, lat2, e) / np.where(same, 1, gap)) * 90 / quarter
    if kind == "isometric":
        return np.where(same, (1 - e.e2) / (w * np.maximum(c, 1e-150)), np.degrees(isometric_difference(lat1, lat2, e)) / np.where(same, 1, gap))
    return (from_geographic(np.where(same, lat2 + 1e-6, lat2), kind, e) - from_geographic(np.where(same, lat1 - 1e-6, lat1), kind, e)) / np.where(same, 2e-6, gap)


def measures(e: Ellipsoid = WGS84) -> dict[str, float]:
    """Quarter of a meridian, area, volume, eccentricities, flattenings, and the radii of spheres of equal meridian and area."""
    quarter = float(meridian(np.zeros(1), np.full(1, 90.0), e)[0])
    return {
        "quarter_meridian": quarter, "area": e.area, "volume": 4 / 3 * np.pi * e.a**2 * e.b, "e2": e.e2, "ep2": e.e2 / (1 - e.e2), "epp2": e.e2 / (2 - e.e2),
        "f": e.f, "second_f": e.f / (1 - e.f), "n": e.n, "rectifying_radius": quarter / (np.pi / 2), "authalic_radius": float(np.sqrt(e.authalic2)),
    }


def radii(lat, azi=0.0, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """circle_radius, circle_height, meridional, transverse, and normal (in the direction azi) at a latitude."""
    lat, azi = _columns(lat, azi)
    (s, c), (sa, ca) = sincosd(lat), sincosd(azi)
    w = 1 - e.e2 * s * s
    rho, nu = e.a * (1 - e.e2) / w**1.5, e.a / np.sqrt(w)
    return {"circle_radius": nu * c, "circle_height": (1 - e.e2) * nu * s, "meridional": rho, "transverse": nu, "normal": 1 / (ca**2 / rho + sa**2 / nu)}
