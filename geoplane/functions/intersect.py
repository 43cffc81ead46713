"""NumPy kernels for intersections of geodesics. Lines X and Y are given by a point and an azimuth; an intersection by the displacements x, y along them.

From trial displacements the lines go on as great circles of a sphere, whose normals' cross product points to where they
meet; repeated, this converges to an intersection of the geodesics near it. Rows that have converged are left alone.
"""

from __future__ import annotations

import numpy as np

from .ellipsoid import WGS84, Ellipsoid
from .geodesic import _columns, difference, direct, inverse, sincosd

ROUNDS = 30


def _angle(to: np.ndarray, along: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The angle from a unit vector towards another by which a third lies."""
    return np.arctan2((to * along).sum(axis=1), (to * at).sum(axis=1))


def _meeting(z, turn_x, turn_y) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two points z apart on the unit sphere, lines through them at angles to the arc between: how far each goes to where they meet, and whether they are one line.

    Coordinates are along the first point, the arc's direction there, and across. Great circles meet at the cross product
    of their normals and opposite to it; the place that is nearer for both together is taken. Circles that are one meet
    half-way.
    """
    (sz, cz), (sx, cx), (sy, cy) = ((np.sin(v), np.cos(v)) for v in (z, turn_x, turn_y))
    zero = np.zeros_like(z)
    p, u = np.stack([zero + 1, zero, zero], axis=1), np.stack([zero, cx, sx], axis=1)
    q, v = np.stack([cz, sz, zero], axis=1), np.stack([-sz * cy, cz * cy, sy], axis=1)
    normal_x, normal_y = np.stack([zero, -sx, cx], axis=1), np.stack([sz * sy, -cz * sy, cy], axis=1)
    meet = np.cross(normal_x, normal_y)
    agree = (normal_x * normal_y).sum(axis=1)
    one = np.abs(meet).max(axis=1, initial=0) < 1e-14
    # two points of one circle: half-way between them, which is where both are if they are the same
    meet[one] = (p + q)[one]
    dx, dy = _angle(meet, u, p), _angle(meet, v, q)
    other_x, other_y = _angle(-meet, u, p), _angle(-meet, v, q)
    swap = np.abs(other_x) + np.abs(other_y) < np.abs(dx) + np.abs(dy)
    return np.where(swap, other_x, dx), np.where(swap, other_y, dy), np.where(one, np.where(agree > 0, 1, -1), 0)


def _steps(lx, ly, x, y, e: Ellipsoid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacements of an intersection near x, y; and whether the lines coincide there (1, or -1 if they run against each other)."""
    radius = np.sqrt(e.authalic2)
    x, y, same = x.copy(), y.copy(), np.zeros(len(x), int)
    left = np.arange(len(x))
    for _ in range(ROUNDS):
        p = direct(*(c[left] for c in lx), x[left], e, fields=("lat2", "lon2", "azi2"))
        q = direct(*(c[left] for c in ly), y[left], e, fields=("lat2", "lon2", "azi2"))
        g = inverse(p["lat2"], p["lon2"], q["lat2"], q["lon2"], e, ("s12", "azi1", "azi2"))
        dx, dy, same[left] = _meeting(g["s12"] / radius, np.radians(difference(g["azi1"], p["azi2"])), np.radians(difference(g["azi2"], q["azi2"])))
        x[left] += radius * dx
        y[left] += radius * dy
        left = left[np.abs(dx) + np.abs(dy) > 1e-12]
        if not len(left):
            break
    return x, y, same


def _lines(*columns) -> tuple[list[np.ndarray], list[np.ndarray]]:
    c = _columns(*columns)
    return c[:3], c[3:]


def _starts(n: int, spread: float, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    steps = range(-reach, reach + 1)
    return [(np.full(n, i * spread), np.full(n, j * spread)) for i in steps for j in steps if (i + j) % 2 == 0]


def _solutions(lx, ly, x0, y0, spread: float, reach: int, e: Ellipsoid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intersections (rows, starts) from starts spread about x0, y0."""
    found = [_steps(lx, ly, x0 + dx, y0 + dy, e) for dx, dy in _starts(len(x0), spread, reach)]
    return tuple(np.stack([f[k] for f in found], axis=1) for k in range(3))


def conjugate_distance(lat, azi, e: Ellipsoid = WGS84) -> np.ndarray:
    """The distance along a geodesic at which those that leave its point near it meet it again: there the reduced length is 0."""
    lat, azi = _columns(lat, azi)
    s = np.full_like(lat, np.pi * e.b)
    for _ in range(10):
        d = direct(lat, 0.0, azi, s, e, fields=("m12", "scale21"))
        s = s - d["m12"] / d["scale21"]
    return s


def closest(lat_x, lon_x, azi_x, lat_y, lon_y, azi_y, x0=0.0, y0=0.0, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """x, y, coincidence of the intersection with the least abs(x - x0) + abs(y - y0)."""
    lx, ly = _lines(lat_x, lon_x, azi_x, lat_y, lon_y, azi_y)
    x0, y0 = (np.broadcast_to(np.asarray(v, np.float64), lx[0].shape) for v in (x0, y0))
    x, y, c = _solutions(lx, ly, x0, y0, np.pi * e.a / 4, 2, e)
    best = np.argmin(np.abs(x - x0[:, None]) + np.abs(y - y0[:, None]) + np.where(np.isnan(x), np.inf, 0), axis=1)
    row = np.arange(len(best))
    return {"x": x[row, best], "y": y[row, best], "coincidence": c[row, best].astype(float)}


def segment(lat_x1, lon_x1, lat_x2, lon_x2, lat_y1, lon_y1, lat_y2, lon_y2, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """x, y, coincidence, inside of the intersection closest to two segments: inside is 1 if it is within both."""
    gx, gy = (inverse(*_columns(*ends), e, ("s12", "azi1")) for ends in ((lat_x1, lon_x1, lat_x2, lon_x2), (lat_y1, lon_y1, lat_y2, lon_y2)))
    out = closest(lat_x1, lon_x1, gx["azi1"], lat_y1, lon_y1, gy["azi1"], gx["s12"] / 2, gy["s12"] / 2, e)
    slack = 1e-6
    x, y = out["x"], out["y"]
    # lines that coincide meet all along: the meeting is moved to where the segments overlap, if they do
    c = out["coincidence"]
    shift_low = np.maximum(-x, np.where(c > 0, -y, y - gy["s12"]))
    shift_high = np.minimum(gx["s12"] - x, np.where(c > 0, gy["s12"] - y, y))
    shift = np.where(c != 0, np.where(shift_low <= shift_high, np.clip(0, shift_low, shift_high), (shift_low + shift_high) / 2), 0.0)
    x, y = x + shift, y + np.where(c < 0, -shift, shift)
    inside = (x >= -slack) & (x <= gx["s12"] + slack) & (y >= -slack) & (y <= gy["s12"] + slack)
    return {"x": x, "y": y, "coincidence": c, "inside": inside * 1.0}


def next_one(lat, lon, azi_x, azi_y, e: Ellipsoid = WGS84) -> dict[str, np.ndarray]:
    """x, y, coincidence of the next closest intersection of two lines that meet at their common point."""
    lx, ly = _lines(lat, lon, azi_x, lat, lon, azi_y)
    zero = np.zeros_like(lx[0])
    x, y, c = _solutions(lx, ly, zero, zero, np.pi * e.a / 4, 5, e)
    length = np.abs(x) + np.abs(y)
    best = np.argmin(np.where(length > 1.0, length, np.inf), axis=1)
    row = np.arange(len(best))
    return {"x": x[row, best], "y": y[row, best], "coincidence": c[row, best].astype(float)}


def within(lat_x, lon_x, azi_x, lat_y, lon_y, azi_y, most: float, e: Ellipsoid = WGS84) -> list[list[tuple[float, float, float]]]:
    """For each row all intersections (x, y, coincidence) with abs(x) + abs(y) at most ``most``, the closest first."""
    lx, ly = _lines(lat_x, lon_x, azi_x, lat_y, lon_y, azi_y)
    zero = np.zeros_like(lx[0])
    x, y, c = _solutions(lx, ly, zero, zero, np.pi * e.a / 4, int(np.ceil(most / (np.pi * e.a / 4))) + 1, e)
    out = []
    for a, b, k in zip(x, y, c):
        kept: list[tuple[float, float, float]] = []
        for i in np.lexsort((b, a, np.abs(a) + np.abs(b))):
            if abs(a[i]) + abs(b[i]) <= most and all(abs(a[i] - p) + abs(b[i] - q) > 1.0 for p, q, _ in kept):  # those a metre apart are one
                kept.append((float(a[i]), float(b[i]), float(k[i])))
        out.append(kept)
    return out
