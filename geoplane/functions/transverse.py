"""NumPy kernels for the transverse Mercator projection by Krueger's series. Degrees and metres."""

from __future__ import annotations

from functools import cache

import numpy as np

from .ellipsoid import WGS84, Ellipsoid
from .elliptic import amplitude, complete, incomplete, jacobi
from .geodesic import difference, sincosd
from .rhumb import isometric

# Krueger's series for the transverse Mercator projection, coefficients of n, n^2, ..., n^6.
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)


def _tm_constants(e: Ellipsoid) -> tuple[float, list[float]]:
    n = e.n
    radius = e.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    return radius, [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in FORWARD]


def transverse_mercator(lon0, lat, lon, k0: float = 1.0, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """x, y about the equator on the meridian lon0, with convergence gamma (degrees) and scale k; within 90 degrees of lon0."""
    lat, lam = np.asarray(lat, np.float64), np.radians(np.remainder(np.asarray(lon, np.float64) - lon0 + 180, 360.0) - 180)
    radius, alpha = _tm_constants(e)
    chi = np.arctan(np.sinh(isometric(lat, e)))
    xi, eta = np.arctan2(np.tan(chi), np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(np.tan(chi), np.cos(lam)))
    z = xi + 1j * eta
    w = z + sum(a * np.sin(2 * (j + 1) * z) for j, a in enumerate(alpha))
    d = 1 + sum(2 * (j + 1) * a * np.cos(2 * (j + 1) * z) for j, a in enumerate(alpha))
    s, _ = sincosd(lat)
    gamma = np.arctan2(np.tan(chi) * np.sin(lam), np.cos(lam) * np.hypot(1, np.tan(chi))) - np.angle(d)
    scale = np.abs(d) * np.sqrt(1 - e.e2 * s * s) * np.hypot(1, np.tan(np.radians(lat))) / np.hypot(np.tan(chi), np.cos(lam)) * radius / e.a
    return {"x": k0 * radius * w.imag, "y": k0 * radius * w.real, "gamma": np.degrees(gamma), "k": k0 * scale}


def transverse_mercator_reverse(lon0, x, y, k0: float = 1.0, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """lat, lon, gamma, k of a projected point, by Newton's method on the series and on the conformal latitude."""
    radius, alpha = _tm_constants(e)
    w = (np.asarray(y, np.float64) + 1j * np.asarray(x, np.float64)) / (k0 * radius)
    z = w.copy()
    for _ in range(6):
        f = z + sum(a * np.sin(2 * (j + 1) * z) for j, a in enumerate(alpha)) - w
        z = z - f / (1 + sum(2 * (j + 1) * a * np.cos(2 * (j + 1) * z) for j, a in enumerate(alpha)))
    lam = np.arctan2(np.sinh(z.imag), np.cos(z.real))
    psi = np.arcsinh(np.sin(z.real) / np.hypot(np.sinh(z.imag), np.cos(z.real)))
    ec, s = np.sqrt(e.e2), np.tanh(psi)
    for _ in range(8):
        s = np.tanh(psi + ec * np.arctanh(ec * s))
    lon = np.degrees(lam) + lon0
    lat = np.degrees(np.arctan(np.sinh(psi + ec * np.arctanh(ec * s))))
    found = transverse_mercator(lon0, lat, lon, k0, e)
    return {"lat": lat, "lon": lon - 360 * np.rint(lon / 360), "gamma": found["gamma"], "k": found["k"]}


class _Plane:
    """The plane of Thompson's projection, w = u + i v: sn w is the sine of the latitude, continued to complex numbers.

    A quarter of the ellipsoid is the rectangle from 0 to K and i K'. Isometric latitude and longitude, psi + i lam, have
    the derivative mv / (cn dn) by w; northing and easting (of a unit ellipsoid), xi + i eta, have mv / dn ** 2. Both are
    level at i K', where they turn three times as fast as w.
    """

    def __init__(self, e: Ellipsoid):
        if e.f <= 0:
            raise ValueError("the ellipsoid must be oblate")
        self.ec, self.mu, self.mv = np.sqrt(e.e2), e.e2, 1 - e.e2
        u, v = complete(self.mu), complete(self.mv)
        self.k, self.ku, self.eu, self.ev = float(u["K"][0]), float(v["K"][0]), float(u["E"][0]), float(v["E"][0])

    def functions(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sn, cn, dn of w, by the addition theorem."""
        a, b = jacobi(w.real, self.mu), jacobi(w.imag, self.mv)
        d = b["cn"] ** 2 + self.mu * (a["sn"] * b["sn"]) ** 2
        sn = (a["sn"] * b["dn"] + 1j * a["cn"] * a["dn"] * b["sn"] * b["cn"]) / d
        cn = (a["cn"] * b["cn"] - 1j * a["sn"] * a["dn"] * b["sn"] * b["dn"]) / d
        dn = (a["dn"] * b["cn"] * b["dn"] - 1j * self.mu * a["sn"] * a["cn"] * b["sn"]) / d
        return sn, cn, dn

    def isometric(self, sn, cn, dn) -> np.ndarray:
        one, two = sn / cn, self.ec * sn / dn
        side = lambda z: np.maximum(z.real, 0) + 0.0 + 1j * z.imag  # the rectangle's edge is on the cut
        return np.arcsinh(side(one)) - self.ec * np.arcsinh(side(two))

    def position(self, w: np.ndarray) -> np.ndarray:
        """xi + i eta: the integral of mv / dn ** 2, along the axis of u and from there."""
        phi_u, phi_v = amplitude(w.real, self.mu), amplitude(w.imag, self.mv)
        (su, cu), (sv, cv) = ((np.sin(p), np.cos(p)) for p in (phi_u, phi_v))
        du, dv = np.sqrt(1 - self.mu * su * su), np.sqrt(self.mu + self.mv * cv * cv)
        d = self.mu * cu * cu + self.mv * cv * cv
        return incomplete(phi_u, self.mu)["E"] - self.mu * su * cu * du / d + 1j * (w.imag - incomplete(phi_v, self.mv)["E"] + self.mv * sv * cv * dv / d)

    def solved(self, target: np.ndarray, first: list[np.ndarray], value, slope) -> np.ndarray:
        """w in the rectangle with value(w) = target, by Newton's method from several starts; the one that comes closest is taken."""
        best, error = np.full(len(target), np.nan + 0j), np.full(len(target), np.inf)
        for w in first:
            left = np.flatnonzero(~(error < 1e-11 * (1 + np.abs(target))))
            if not len(left):
                break
            w, on = w.astype(complex).copy(), left
            for _ in range(40):
                f = self.functions(w[on])
                step = (value(w[on], f) - target[on]) / slope(f)
                step = np.where(np.isfinite(step), step, 0)
                step *= np.minimum(1, 0.3 / np.maximum(np.abs(step), 1e-300))
                z = w[on] - step
                w[on] = np.clip(z.real, 0, self.k) + 1j * np.clip(z.imag, 0, self.ku)
                on = on[np.abs(step) > 1e-15]
                if not len(on):
                    break
            off = np.abs(value(w[left], self.functions(w[left])) - target[left])
            better = off < error[left]
            best[left[better]], error[left[better]] = w[left[better]], off[better]
        return best

    def near_the_edge(self, away: np.ndarray) -> np.ndarray:
        """The start by the first term at i K': a third of the turn there, in the rectangle."""
        turn = np.cbrt(np.abs(away)) * np.exp(1j * (np.angle(away) - np.pi) / 3)
        return np.clip(turn.real, 1e-6, self.k) + 1j * np.clip(self.ku + turn.imag, 0, self.ku - 1e-6)


@cache
def _plane(e: Ellipsoid) -> _Plane:
    return _Plane(e)


def _shape(plane: _Plane, w: np.ndarray, lat: np.ndarray, k0: float) -> tuple[np.ndarray, np.ndarray]:
    """Convergence (degrees) and scale at w: the derivative of the position by isometric latitude and longitude is cn / dn."""
    _, cn, dn = plane.functions(w)
    turn = cn / dn
    s, c = sincosd(lat)
    return -np.degrees(np.angle(turn)), k0 * np.abs(turn) * np.sqrt(1 - plane.mu * s * s) / np.where(c > 0, c, np.nan)


def transverse_mercator_exact(lon0, lat, lon, k0: float = 1.0, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """x, y, gamma, k of the projection itself, without a series, on the whole of an oblate ellipsoid."""
    lat, lon = np.broadcast_arrays(np.atleast_1d(np.asarray(lat, np.float64)), np.asarray(lon, np.float64))
    plane, lam = _plane(e), difference(lon0, lon)
    south, west = np.signbit(lat), np.signbit(lam)
    lat, lam = np.abs(lat), np.abs(lam)
    back = lam > 90
    south = south | (back & (lat == 0) & ~south)  # the far half of the equator is mapped as its southern side
    lam = np.where(back, 180 - lam, lam)
    zeta = isometric(lat, e) + 1j * np.radians(lam)
    s, c = sincosd(lam)
    u, v = np.arctan2(np.sinh(zeta.real), c), np.arcsinh(s / np.hypot(np.sinh(zeta.real), np.where(c == 0, 1e-300, c)))
    as_sphere = u * plane.k / (np.pi / 2) + 1j * np.minimum(v * plane.k / (np.pi / 2), 0.98 * plane.ku)
    edge = plane.near_the_edge((zeta - 1j * (1 - plane.ec) * np.pi / 2) * (3 / (plane.mv * plane.ec)))
    close = (zeta.real < plane.ec * np.pi / 2) & (lam > 75)
    starts = [np.where(close, edge, as_sphere), np.where(close, as_sphere, edge), *(np.full(len(lat), plane.k * a + 1j * plane.ku * b) for a in (0.1, 0.5, 0.9) for b in (0.9, 0.5, 0.1))]
    w = plane.solved(zeta, starts, lambda w, f: plane.isometric(*f), lambda f: plane.mv / (f[1] * f[2]))
    pole = lat == 90
    w = np.where(pole, plane.k + 0j, w)
    sigma = plane.position(w)
    gamma, k = _shape(plane, w, lat, k0)
    gamma, k = np.where(pole, lam, gamma), np.where(pole, k0, k)
    xi = np.where(back, 2 * plane.eu - sigma.real, sigma.real)
    gamma = np.where(back, 180 - gamma, gamma)
    bad = ~(lat <= 90) | ~np.isfinite(lam)
    sign = lambda flip, x: np.where(bad, np.nan, np.where(flip, -x, x))
    return {"x": sign(west, k0 * e.a * sigma.imag), "y": sign(south, k0 * e.a * xi), "gamma": sign(south != west, gamma), "k": sign(False, k)}


def transverse_mercator_exact_reverse(lon0, x, y, k0: float = 1.0, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """lat, lon, gamma, k of x, y; NaN beyond the map's outline."""
    x, y = np.broadcast_arrays(np.atleast_1d(np.asarray(x, np.float64)), np.asarray(y, np.float64))
    plane = _plane(e)
    xi, eta = np.abs(y) / (k0 * e.a), np.abs(x) / (k0 * e.a)
    south, west, back = np.signbit(y), np.signbit(x), xi > plane.eu
    sigma = np.where(back, 2 * plane.eu - xi, xi) + 1j * eta
    flat = sigma.real * plane.k / plane.eu + 1j * np.minimum(eta * plane.k / plane.eu, 0.98 * plane.ku)
    edge = plane.near_the_edge((sigma - 1j * (plane.ku - plane.ev)) * (3 / plane.mv))
    close = (eta > 0.75 * (plane.ku - plane.ev)) & (sigma.real < 0.25 * plane.eu)
    far = plane.k + 1j * plane.ku + 1j / np.where(sigma == 0, 1e-300, sigma) * 1.0  # the pole of the position is at the corner
    corner = np.clip(far.real, 0, plane.k) + 1j * np.clip(far.imag, 0, plane.ku)
    starts = [np.where(close, edge, flat), np.where(close, flat, edge), corner, *(np.full(len(x), plane.k * a + 1j * plane.ku * b) for a in (0.1, 0.5, 0.9) for b in (0.9, 0.5, 0.1))]
    w = plane.solved(sigma, starts, lambda w, f: plane.position(w), lambda f: plane.mv / f[2] ** 2)
    sn, cn, dn = plane.functions(w)
    zeta = plane.isometric(sn, cn, dn)
    off = ~(np.abs(plane.position(w) - sigma) < 1e-9 * (1 + np.abs(sigma)))
    lat = _latitude(zeta.real, e)
    lam = np.degrees(zeta.imag)
    pole = np.abs(w - plane.k) < 1e-15
    gamma, k = _shape(plane, w, lat, k0)
    lat, lam, gamma, k = np.where(pole, 90, lat), np.where(pole, 0, lam), np.where(pole, 0, gamma), np.where(pole, k0, k)
    lam, gamma = np.where(back, 180 - lam, lam), np.where(back, 180 - gamma, gamma)
    sign = lambda flip, v: np.where(off, np.nan, np.where(flip, -v, v))
    lon = lon0 + sign(west, lam)
    return {"lat": sign(south, lat), "lon": lon - 360 * np.rint(lon / 360), "gamma": sign(south != west, gamma), "k": sign(False, k)}


def _latitude(psi: np.ndarray, e: Ellipsoid) -> np.ndarray:
    """Degrees of an isometric latitude, by Newton's method on the tangent."""
    tau = np.sinh(psi)
    ec = np.sqrt(e.e2)
    for _ in range(12):
        s = tau / np.hypot(1, tau)
        off = np.arcsinh(tau) - ec * np.arctanh(ec * s) - psi
        tau = tau - off * np.hypot(1, tau) * (1 - e.e2 * s * s) / (1 - e.e2)
    return np.degrees(np.arctan(tau))
