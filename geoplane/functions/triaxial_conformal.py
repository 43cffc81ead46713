"""Jacobi's conformal projection of a triaxial ellipsoid, on arrays. Degrees and metres.

With u = F(bet, k2) and v = F(omg - 90, kp2), in which the surface's lines of curvature are a net of squares but for slowly varying factors,
y is the integral of sqrt(b^2 sn^2 + c^2 cn^2) over u, and x that of sqrt(a^2 cn^2 + b^2 sn^2) over v: both are elliptic integrals of the third kind.
"""

from __future__ import annotations

import numpy as np

from . import elliptic
from .geodesic import _columns, sincosd
from .triaxial import Triaxial


def _argument(degrees: np.ndarray, k2: float) -> np.ndarray:
    """F at an amplitude in degrees, any number of turns; with k2 = 1 infinite at 90."""
    if k2 >= 1:
        with np.errstate(divide="ignore"):
            return np.where(np.abs(degrees) == 90, np.copysign(np.inf, degrees), np.arcsinh(np.tan(np.radians(np.where(np.abs(degrees) == 90, 0, degrees)))))
    return elliptic.incomplete(np.radians(degrees), k2)["F"]


def _amplitude(u: np.ndarray, k2: float) -> np.ndarray:
    """In radians."""
    return np.arctan(np.sinh(u)) if k2 >= 1 else elliptic.amplitude(u, k2)


def _length(phi: np.ndarray, k2: float, p: float, q: float) -> np.ndarray:
    """The integral of sqrt((p^2 cos^2 + q^2 sin^2) / (1 - k2 sin^2)) from 0 to an amplitude in radians: p^2 / q Pi of the amplitude whose tangent is q / p as large."""
    halves = np.rint(phi / np.pi)
    s, c = q * np.sin(phi - np.pi * halves), p * np.cos(phi - np.pi * halves)
    size = np.hypot(s, c)
    s, c2, n = s / size, (c / size) ** 2, 1 - (p / q) ** 2
    rest = (1 - k2) * (p / q) ** 2  # 1 less the new parameter
    delta = c2 + rest * s * s
    open_end = delta > 0
    delta, c2 = np.where(open_end, delta, 1.0), np.where(open_end, c2, 1.0)
    own = s * elliptic.rf(c2, delta, 1) + n * s**3 * elliptic.rj(c2, delta, 1, 1 - n * s * s) / 3
    own = np.where(open_end, own, np.copysign(np.inf, s))
    whole = halves * 2 * _quarter(k2, p, q) * q / p**2 if halves.any() else 0.0
    return p**2 / q * (own + whole)


def _quarter(k2: float, p: float, q: float) -> float:
    return np.inf if k2 >= 1 else p**2 / q * float(elliptic.complete(1 - (1 - k2) * (p / q) ** 2, 1 - (p / q) ** 2)["Pi"][0])


def _inverse_length(x: np.ndarray, k2: float, p: float, q: float) -> np.ndarray:
    """The amplitude, in radians, of a length: Newton's method on u, in which the slope lies between p and q."""
    u = x / np.sqrt(p * q)
    for _ in range(40):
        phi = _amplitude(u, k2)
        s2 = np.sin(phi) ** 2
        step = (_length(phi, k2, p, q) - x) / np.sqrt(p * p * (1 - s2) + q * q * s2)
        step = np.where(np.isfinite(step), step, 0.0)
        u = u - step
        if not (np.abs(step) > 1e-9 * (1 + np.abs(u))).any():
            break
    return _amplitude(u, k2)


def _scale(t: Triaxial, bet, omg) -> np.ndarray:
    k2, kp2 = t._k
    (_, cb), (so, _) = sincosd(bet), sincosd(omg)
    with np.errstate(divide="ignore"):
        return 1 / np.sqrt(k2 * cb**2 + kp2 * so**2)


def quadrant(t: Triaxial) -> tuple[float, float]:
    """x and y of a quarter of the equator and of a quarter of the middle section; infinite where the ellipsoid is one of revolution."""
    k2, kp2 = t._k
    return _quarter(kp2, t.a, t.b), _quarter(k2, t.c, t.b)


def forward(t: Triaxial, bet, omg) -> dict[str, np.ndarray]:
    """x, y, k of ellipsoidal coordinates, |bet| <= 90; x is 0 at omg = 90 and grows by turns. k is infinite at umbilical points. NaN where an argument isn't finite."""
    bet, omg = _columns(bet, omg)
    good = np.isfinite(bet + omg) & (np.abs(bet) <= 90)
    bet, omg = np.where(good, bet, 0.0), np.where(good, omg, 0.0)
    k2, kp2 = t._k
    out = {"x": _length(np.radians(omg - 90), kp2, t.a, t.b), "y": _length(np.radians(bet), k2, t.c, t.b), "k": _scale(t, bet, omg)}
    return {n: np.where(good, v, np.nan) for n, v in out.items()}


def reverse(t: Triaxial, x, y) -> dict[str, np.ndarray]:
    """bet, omg, k. NaN where an argument isn't finite or y is over a quarter of the middle section."""
    x, y = _columns(x, y)
    top = quadrant(t)[1]
    good = np.isfinite(x + y) & (np.abs(y) <= top * (1 + 1e-15))
    x, y = np.where(good, x, 0.0), np.where(good, y, 0.0)
    k2, kp2 = t._k
    bet = np.degrees(_inverse_length(y, k2, t.c, t.b))
    omg = np.degrees(_inverse_length(x, kp2, t.a, t.b)) + 90
    bet = np.where(np.abs(y) >= top, np.copysign(90.0, y), np.clip(bet, -90, 90))
    out = {"bet": bet, "omg": omg, "k": _scale(t, bet, omg)}
    return {n: np.where(good, v, np.nan) for n, v in out.items()}


def sphere(t: Triaxial) -> tuple[float, float]:
    """Radius of the sphere, and its k2, on whose net of elliptic coordinates the ellipsoid has the same plane: the ratio of the quarters gives the nome."""
    x0, y0 = quadrant(t)
    if not np.isfinite(x0 + y0):
        raise ValueError("an ellipsoid of revolution has no such sphere")
    # K(kp2) / K(k2) = x0 / y0; theta series of the nome that is smaller
    small = np.exp(-np.pi * max(x0 / y0, y0 / x0))
    n = np.arange(1, 8)
    k2 = (2 * small**0.25 * (1 + (small ** (n * (n + 1))).sum()) / (1 + 2 * (small ** (n * n)).sum())) ** 4
    if x0 < y0:
        k2 = 1 - k2
    return y0 / float(elliptic.complete(k2)["K"][0]), k2


def to_sphere(t: Triaxial, bet, omg) -> dict[str, np.ndarray]:
    """x, y, z on the sphere of ``sphere``, and k, the scale of that conformal map (NaN at umbilical points)."""
    bet, omg = _columns(bet, omg)
    r, k2 = sphere(t)
    flat = forward(t, bet, omg)
    f, g = _amplitude(flat["y"] / r, k2), _amplitude(flat["x"] / r, 1 - k2)
    sb, cb, so, co = np.sin(f), np.cos(f), np.cos(g), -np.sin(g)
    with np.errstate(invalid="ignore"):
        k = flat["k"] * np.sqrt(k2 * cb**2 + (1 - k2) * so**2)
    return {"x": r * co * np.sqrt(k2 * cb**2 + 1 - k2), "y": r * cb * so, "z": r * sb * np.sqrt(k2 + (1 - k2) * so**2), "k": k}


def from_sphere(t: Triaxial, x, y, z) -> dict[str, np.ndarray]:
    """bet, omg of a point of the sphere of ``sphere``."""
    r, k2 = sphere(t)
    net = Triaxial(1.0, 1.0, 1.0)
    at = net._lines_of(np.stack(_columns(x, y, z)) / np.sqrt(sum(v * v for v in _columns(x, y, z))), k2, 1 - k2)
    back = reverse(t, r * _argument(at["omg"] - 90, 1 - k2), np.clip(r * _argument(at["bet"], k2), -quadrant(t)[1], quadrant(t)[1]))
    return {"bet": back["bet"], "omg": back["omg"]}


def to_other(t: Triaxial, other: Triaxial, bet, omg) -> dict[str, np.ndarray]:
    """bet, omg on another triaxial ellipsoid, by way of both spheres, and k, the scale of that conformal map."""
    at = to_sphere(t, bet, omg)
    there = from_sphere(other, at["x"], at["y"], at["z"])
    with np.errstate(invalid="ignore", divide="ignore"):
        k = at["k"] * sphere(other)[0] / sphere(t)[0] / to_sphere(other, there["bet"], there["omg"])["k"]
    return there | {"k": k}
