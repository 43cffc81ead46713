"""Elliptic integrals and functions, on arrays, by Carlson's duplication and the arithmetic-geometric mean."""

from __future__ import annotations

import numpy as np

ROUNDS = 30


def _arrays(*x) -> list[np.ndarray]:
    return [np.array(v, np.float64) for v in np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, np.float64)) for v in x))]


def rf(x, y, z) -> np.ndarray:
    x, y, z = _arrays(x, y, z)
    for _ in range(ROUNDS):
        root = np.sqrt(x * y) + np.sqrt(y * z) + np.sqrt(z * x)
        x, y, z = (x + root) / 4, (y + root) / 4, (z + root) / 4
    return 1 / np.sqrt((x + y + z) / 3)


def rc(x, y) -> np.ndarray:
    x, y = _arrays(x, y)
    gap = np.sqrt(np.abs(y - x))
    some = gap > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        above = np.arctan2(gap, np.sqrt(x))
        below = np.where(2 * y < x, np.log((np.sqrt(x) + gap) / np.sqrt(y)), np.arctanh(gap / np.sqrt(x)))
        return np.where(some, np.where(y > x, above, below) / np.where(some, gap, 1), 1 / np.sqrt(x))


def rd(x, y, z) -> np.ndarray:
    x, y, z = _arrays(x, y, z)
    total, scale = np.zeros_like(x), 1.0
    for _ in range(ROUNDS):
        sz = np.sqrt(z)
        root = np.sqrt(x * y) + np.sqrt(y) * sz + sz * np.sqrt(x)
        total += scale / (sz * (z + root))
        scale /= 4
        x, y, z = (x + root) / 4, (y + root) / 4, (z + root) / 4
    return 3 * total + scale / ((x + y + 3 * z) / 5) ** 1.5


def rj(x, y, z, p) -> np.ndarray:
    x, y, z, p = _arrays(x, y, z, p)
    total, scale = np.zeros_like(x), 1.0
    for _ in range(ROUNDS):
        sx, sy, sz, sp = np.sqrt(x), np.sqrt(y), np.sqrt(z), np.sqrt(p)
        root = sx * sy + sy * sz + sz * sx
        d = (sp + sx) * (sp + sy) * (sp + sz)
        e = (p - x) * (p - y) * (p - z) / d**2
        total += scale * rc(1, 1 + e) / d
        scale /= 4
        x, y, z, p = (x + root) / 4, (y + root) / 4, (z + root) / 4, (p + root) / 4
    return 6 * total + scale / ((x + y + z + 2 * p) / 5) ** 1.5


def rg(x, y, z) -> np.ndarray:
    x, y, z = (np.sort(np.stack(_arrays(x, y, z)), axis=0)[k] for k in range(3))
    some = z > 0
    z = np.where(some, z, 1.0)
    return np.where(some, (z * rf(x, y, z) - (x - z) * (y - z) * rd(x, y, z) / 3 + np.sqrt(x * y / z)) / 2, 0.0)


def complete(k2, alpha2=0.0) -> dict[str, np.ndarray]:
    """K, E, D, Pi, G, H of the parameters k2 < 1 and alpha2 < 1."""
    k2, alpha2 = _arrays(k2, alpha2)
    kp2, ap2 = 1 - k2, 1 - alpha2
    k, d, j = rf(0, kp2, 1), rd(0, kp2, 1) / 3, rj(0, kp2, 1, ap2) / 3
    return {"K": k, "E": 2 * rg(0, kp2, 1), "D": d, "Pi": k + alpha2 * j, "G": k + (alpha2 - k2) * j, "H": k - ap2 * j}


def incomplete(phi, k2, alpha2=0.0) -> dict[str, np.ndarray]:
    """F, E, D, Pi, G, H at the amplitude phi (radians, any)."""
    phi, k2, alpha2 = _arrays(phi, k2, alpha2)
    turns = np.rint(phi / np.pi)
    s, c = np.sin(phi - np.pi * turns), np.cos(phi - np.pi * turns)
    delta, c2, s2 = 1 - k2 * s * s, c * c, s * s
    f, d, j = s * rf(c2, delta, 1), s**3 * rd(c2, delta, 1) / 3, s**3 * rj(c2, delta, 1, 1 - alpha2 * s2) / 3
    own = {"F": f, "E": f - k2 * d, "D": d, "Pi": f + alpha2 * j, "G": f + (alpha2 - k2) * j, "H": f - (1 - alpha2) * j}
    whole = complete(k2, alpha2)
    return {n: v + 2 * turns * whole["K" if n == "F" else n] for n, v in own.items()}


def inverse_e(x, k2) -> np.ndarray:
    """The amplitude at which the incomplete E is x."""
    x, k2 = _arrays(x, k2)
    phi = x * np.pi / 2 / complete(k2)["E"]
    for _ in range(30):
        phi = phi - (incomplete(phi, k2)["E"] - x) / np.sqrt(1 - k2 * np.sin(phi) ** 2)
    return phi


def amplitude(x, k2) -> np.ndarray:
    """Jacobi's am(x), by the descending mean; 0 <= k2 < 1, or k2 < 0 by the imaginary modulus."""
    x, k2 = _arrays(x, k2)
    negative = k2 < 0
    m, scale = np.where(negative, -k2 / (1 - k2), k2), np.where(negative, np.sqrt(1 - np.minimum(k2, 0)), 1.0)
    shift = np.where(negative, complete(m)["K"], 0.0)
    u = x * scale + shift * 0
    a, b, steps = np.ones_like(m), np.sqrt(1 - m), []
    c = np.sqrt(m)
    for _ in range(12):
        steps.append((a, c))
        a, b, c = (a + b) / 2, np.sqrt(a * b), (a - b) / 2
    phi = u * a * 2.0**12
    for (a0, _), (a1, c1) in reversed(list(zip(steps, steps[1:] + [(a, c)]))):
        phi = (phi + np.arcsin(np.clip(c1 / a1 * np.sin(phi), -1, 1))) / 2
    # with k2 < 0: sn(x, k2) = sd(scale x, m) / scale, cn = cd, dn = nd
    turns = np.rint(phi / np.pi)
    s, cosine = np.sin(phi - np.pi * turns), np.cos(phi - np.pi * turns)
    dn = np.sqrt(1 - m * s * s)
    return np.where(negative, np.arctan2(s / dn / scale, cosine / dn) + np.pi * turns, phi)


def jacobi(x, k2) -> dict[str, np.ndarray]:
    """sn, cn, dn."""
    phi = amplitude(x, k2)
    s = np.sin(phi)
    return {"sn": s, "cn": np.cos(phi), "dn": np.sqrt(1 - np.asarray(k2) * s * s)}
