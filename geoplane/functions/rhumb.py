"""NumPy kernels for rhumb lines, on arrays of points. Degrees and metres."""

from __future__ import annotations

import numpy as np

from .ellipsoid import WGS84, Ellipsoid
from .geodesic import _columns, difference, integral, normalized, sincosd


def _eccentric(e: Ellipsoid) -> tuple[float, bool]:
    return np.sqrt(abs(e.e2)), e.e2 >= 0


def _bulge(x, e: Ellipsoid):
    """ec atanh(ec x), for an oblate or prolate ellipsoid."""
    ec, oblate = _eccentric(e)
    return ec * np.arctanh(ec * x) if oblate else -ec * np.arctan(ec * x)


def isometric(lat, e: Ellipsoid):
    """Isometric latitude in radians; about +-345 at a pole."""
    s, c = sincosd(lat)
    return np.arcsinh(s / np.maximum(c, 1e-150)) - _bulge(s, e)


def isometric_difference(lat1, lat2, e: Ellipsoid):
    """isometric(lat2) - isometric(lat1), to full relative accuracy however near the latitudes are."""
    (s1, c1), (s2, c2) = sincosd(lat1), sincosd(lat2)
    c1, c2 = np.maximum(c1, 1e-150), np.maximum(c2, 1e-150)
    half, mid = (lat2 - lat1) / 2, (lat2 + lat1) / 2
    ds = 2 * sincosd(mid)[1] * sincosd(half)[0]
    ec, oblate = _eccentric(e)
    x = ec * ds / (1 - e.e2 * s1 * s2)
    return np.arcsinh(ds / c1 / c2) - (ec * np.arctanh(x) if oblate else -ec * np.arctan(x))


def latitude(psi, e: Ellipsoid):
    """Degrees of latitude of an isometric latitude in radians."""
    s = np.tanh(psi)
    for _ in range(12):
        s = np.tanh(psi + _bulge(s, e))
    return np.degrees(np.arctan(np.sinh(psi + _bulge(s, e))))


def meridian(lat1, lat2, e: Ellipsoid):
    """Metres along a meridian; latitudes may go on beyond a pole."""
    of = np.result_type(lat1, lat2, np.float64).type
    rate = np.radians(e.a * (1 - of(e.e2)))

    def g(t):
        w = 1 - e.e2 * np.sin(np.radians(t)) ** 2
        return rate / (w * np.sqrt(w) if of is np.longdouble else w**1.5)

    return integral(g, lat1, lat2)  # over degrees, whose difference is exact for near latitudes


def sin_authalic(lat, e: Ellipsoid):
    """Sine of the authalic latitude."""
    s, _ = sincosd(lat)
    if e.e2 == 0:
        return s
    q = lambda x: x / (1 - e.e2 * x * x) + _bulge(x, e) / e.e2
    return q(s) / q(1.0)


def _mean_sine(lat1, lat2, psi12, e: Ellipsoid):
    """The mean of the authalic latitude's sine along a rhumb line."""
    low = isometric(lat1, e)
    high, far, out = low + psi12, 20.0, sin_authalic(lat1, e)

    def g(p):
        s = np.tanh(p)
        for _ in range(9):
            s = np.tanh(p + _bulge(s, e))
        return sin_authalic(np.degrees(np.arcsin(np.clip(s, -1, 1))), e)

    # panels are 1.25 wide at the most, as many as a line's length takes
    panels = np.ceil(np.abs(np.clip(high, -far, far) - np.clip(low, -far, far)) / 1.25)
    for n in np.unique(panels[psi12 != 0]).tolist():
        on = np.flatnonzero((panels == n) & (psi12 != 0))
        a, b = np.clip(low[on], -far, far), np.clip(high[on], -far, far)
        beyond = (high[on] - b) - (low[on] - a)  # there the sine is +-1
        out[on] = (integral(g, a, b, max(1, int(n))) + np.abs(beyond) * np.sign(np.where(np.abs(high[on]) > far, high[on], low[on])) * np.sign(psi12[on])) / psi12[on]
    return out


def _per_radian(lat1, lat2, along, psi12, e: Ellipsoid):
    """Metres for a unit of isometric latitude, between two latitudes."""
    s, c = sincosd((lat1 + lat2) / 2)
    return np.where(psi12 == 0, e.a * c / np.sqrt(1 - e.e2 * s * s), along / np.where(psi12 == 0, 1, psi12))


def _length(lat1, lon1, lat2, lon2, lam, e: Ellipsoid):
    """s12 by long doubles, where there are any: the double next to it, so that its decimals round as the length does. ``lam``: about its radians of longitude."""
    lat1, lat2 = lat1.astype(np.longdouble), lat2.astype(np.longdouble)
    turn = normalized(lon2).astype(np.longdouble) - normalized(lon1)
    lam, psi = np.radians(turn - 360 * np.rint((turn - np.degrees(lam)) / 360)), isometric_difference(lat1, lat2, e)
    return (np.hypot(lam, psi) * _per_radian(lat1, lat2, meridian(lat1, lat2, e), psi, e)).astype(np.float64)


def rhumb_inverse(lat1, lon1, lat2, lon2, e: Ellipsoid = WGS84, area: bool = True) -> dict[str, np.ndarray]:
    """azi12, s12 and area12 (the area under the line) of the shorter rhumb line; east, if both are as short and lon2 - lon1 is +180."""
    lat1, lon1, lat2, lon2 = _columns(lat1, lon1, lat2, lon2)
    bad = ~(np.isfinite(lat1 + lon1 + lat2 + lon2) & (np.abs(lat1) <= 90) & (np.abs(lat2) <= 90))
    lat1, lon1, lat2, lon2 = (np.where(bad, 0.0, v) for v in (lat1, lon1, lat2, lon2))
    lam, psi = np.radians(difference(lon1, lon2)), isometric_difference(lat1, lat2, e)
    out = {"azi12": np.degrees(np.arctan2(lam, psi)), "s12": _length(lat1, lon1, lat2, lon2, lam, e)}
    if area:
        out["area12"] = e.authalic2 * lam * _mean_sine(lat1, lat2, psi, e)
    return {k: np.where(bad, np.nan, v) for k, v in out.items()}


def rhumb_direct(lat1, lon1, azi12, s12, e: Ellipsoid = WGS84, unroll: bool = False, area: bool = True) -> dict[str, np.ndarray]:
    """lat2, lon2 and area12. A line that goes over a pole comes down on the other side, where lon2 and area12 are NaN."""
    lat1, lon1, azi12, s12 = _columns(lat1, lon1, azi12, s12)
    lat1 = np.where(np.abs(lat1) <= 90, lat1, np.nan)
    sa, ca = sincosd(azi12)
    lat2 = lat1 + np.degrees(s12 * ca / e.a)
    for _ in range(8):
        s = np.sin(np.radians(lat2))
        lat2 = lat2 + np.degrees((s12 * ca - meridian(lat1, lat2, e)) * (1 - e.e2 * s * s) ** 1.5 / (e.a * (1 - e.e2)))
    over = np.abs(lat2) > 90
    end = np.where(over, 0.0, lat2)
    psi = isometric_difference(lat1, end, e)
    lam = s12 * sa / _per_radian(lat1, end, s12 * ca, psi, e)
    lat2 = normalized(lat2)
    out = {"lat2": np.where(np.abs(lat2) > 90, np.copysign(180, lat2) - lat2, lat2)}
    way = np.degrees(lam)
    out["lon2"] = np.where(over, np.nan, lon1 + way if unroll else normalized(normalized(lon1) + normalized(way)))
    if area:
        fine = ~over & np.isfinite(psi)
        out["area12"] = np.where(fine, e.authalic2 * lam * _mean_sine(np.where(fine, lat1, 0), np.where(fine, end, 0), np.where(fine, psi, 0), e), np.nan)
    return out
