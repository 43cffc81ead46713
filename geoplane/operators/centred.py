"""Projections about a centre, as struct columns in Arrow batches."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import azimuthal, transverse
from ..functions.ellipsoid import WGS84, Ellipsoid
from .geodesics import kernel

FORWARD = {"equidistant": azimuthal.equidistant, "gnomonic": azimuthal.gnomonic, "cassini": azimuthal.cassini}
REVERSE = {"equidistant": azimuthal.equidistant_reverse, "gnomonic": azimuthal.gnomonic_reverse, "cassini": azimuthal.cassini_reverse}


def forward(kind: str, lat0: Column, lon0: Column, lat: Column, lon: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y, azi, rk of the ``kind``: equidistant, gnomonic (NaN beyond the horizon) or cassini."""
    return kernel(partial(FORWARD[kind], e=e), "x y azi rk", lat0, lon0, lat, lon)


def reverse(kind: str, lat0: Column, lon0: Column, x: Column, y: Column, e: Ellipsoid = WGS84) -> Column:
    """Struct lat, lon, azi, rk."""
    return kernel(partial(REVERSE[kind], e=e), "lat lon azi rk", lat0, lon0, x, y)


def transverse_mercator_exact(lon0: Column, lat: Column, lon: Column, k0: float = 1.0, e: Ellipsoid = WGS84) -> Column:
    """Struct x, y, gamma (convergence), k (scale) without a series, on the whole ellipsoid."""
    return kernel(partial(transverse.transverse_mercator_exact, k0=k0, e=e), "x y gamma k", lon0, lat, lon)


def transverse_mercator_exact_reverse(lon0: Column, x: Column, y: Column, k0: float = 1.0, e: Ellipsoid = WGS84) -> Column:
    """Struct lat, lon, gamma, k; null beyond the map's outline."""
    return kernel(partial(transverse.transverse_mercator_exact_reverse, k0=k0, e=e), "lat lon gamma k", lon0, x, y)


def centred(kind: str, lat: Column, lon: Column, lat0: float, lon0: float, e: Ellipsoid = WGS84) -> Column:
    """``forward`` about a fixed centre."""
    return forward(kind, F.lit(lat0), F.lit(lon0), lat, lon, e)
