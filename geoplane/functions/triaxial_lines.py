"""Geodesics on triaxial ellipsoids, on arrays. Degrees and metres.

The line is followed in space: its second derivative is along the surface's normal, and the distance m of its neighbours obeys m'' = -K m with
the curvature K, so one shot gives the end and how the end moves with the azimuth. Shots are extrapolated midpoint steps.
"""

from __future__ import annotations

import numpy as np

from .geodesic import _columns, sincosd
from .triaxial import Triaxial

SUBSTEPS = 2 * np.arange(1, 8)
STEP = 0.5  # of the least radius of curvature that a step may cover
FAN = 48
ROWS = 100  # whose fans are open at once


def _slopes(y: np.ndarray, w: np.ndarray, gauss: float) -> np.ndarray:
    """Of (r, v, m, m', M, M'), [10, rows]; w are the squares of the axes upside down."""
    r, v = y[:3], y[3:6]
    u = w * r
    size = (u * u).sum(axis=0)
    curved = gauss / (size * size)
    out = np.empty_like(y)
    out[:3] = v
    out[3:6] = -((w * v * v).sum(axis=0) / size) * u
    out[6], out[7], out[8], out[9] = y[7], -curved * y[6], y[9], -curved * y[8]
    return out


def _on_surface(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    y[:3] /= np.sqrt((w * y[:3] ** 2).sum(axis=0))
    n = w * y[:3]
    y[3:6] -= n * ((n * y[3:6]).sum(axis=0) / (n * n).sum(axis=0))
    y[3:6] /= np.sqrt((y[3:6] ** 2).sum(axis=0))
    return y


def _step(y: np.ndarray, h: np.ndarray, w: np.ndarray, gauss: float) -> np.ndarray:
    """One step of Gragg's midpoint rule with 2, 4, ... 14 parts, extrapolated in the squares of their lengths."""
    first, table = _slopes(y, w, gauss), []
    for i, n in enumerate(SUBSTEPS):
        part = h / n
        before, now = y, y + part * first
        for _ in range(n - 1):
            before, now = now, before + 2 * part * _slopes(now, w, gauss)
        row = [(before + now + part * _slopes(now, w, gauss)) / 2]
        for j in range(1, i + 1):
            row.append(row[-1] + (row[-1] - table[j - 1]) / ((n / SUBSTEPS[i - j]) ** 2 - 1))
        table = row
    return table[-1]


def shoot(t: Triaxial, r: np.ndarray, v: np.ndarray, s, keep: bool = False):
    """States [10, rows] (r, v, m, m', M, M') at the distances s from r [3, rows] along v; with ``keep`` those after each step, [steps, 10, rows]."""
    w = 1 / t.axes2[:, None]
    s = np.broadcast_to(np.asarray(s, float), r.shape[1:])
    y = np.concatenate([r, v, np.zeros_like(r[:1]), np.ones_like(r[:1]), np.ones_like(r[:1]), np.zeros_like(r[:1])])
    y, states = _on_surface(y, w), []
    longest = np.nanmax(np.abs(s), initial=0.0)
    steps = max(1, int(np.ceil(longest / (STEP * t.c**2 / t.a))))
    for _ in range(steps):
        y = _on_surface(_step(y, s / steps, w, float(np.prod(1 / t.axes2))), w)
        states.append(y)
    return np.stack(states) if keep else y


def frame(t: Triaxial, bet, omg) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points r, and unit vectors along growing omg (east) and bet (north), [3, rows] each.

    At an umbilical point both lines of curvature end; there, by convention, east is along y, forward where x > 0.
    """
    bet, omg = _columns(bet, omg)
    p = t.ellipsoidal(bet, omg)
    r = np.stack([p["x"], p["y"], p["z"]])
    (sb, cb), (so, co) = sincosd(bet), sincosd(omg)
    k2, kp2 = t._k
    qb, qo = np.sqrt(k2 * cb**2 + kp2), np.sqrt(k2 + kp2 * so**2)
    over = lambda x, q, end: np.where(q > 0, x / np.where(q > 0, q, 1), end)
    east = np.stack([-t.a * so * qb, t.b * cb * co, t.c * sb * over(kp2 * so * co, qo, np.sqrt(kp2) * co)])
    north = np.stack([-t.a * co * sb * over(k2 * cb, qb, np.sqrt(k2)), -t.b * sb * so, t.c * cb * qo])
    n = r / t.axes2[:, None]
    n /= np.sqrt((n * n).sum(axis=0))
    e, f = (np.sqrt((x * x).sum(axis=0)) for x in (east, north))
    other = np.cross(north, n, axis=0)
    umbilic = np.stack([np.zeros_like(co), np.where(co < 0, -1.0, 1.0), np.zeros_like(co)])
    east = np.where(e >= f, east, other)
    east = np.where(np.maximum(e, f) > 1e-15 * t.a, east, umbilic)
    east = east - n * (east * n).sum(axis=0)
    east /= np.sqrt((east * east).sum(axis=0))
    return r, east, np.cross(n, east, axis=0)


def _azimuth(v: np.ndarray, east: np.ndarray, north: np.ndarray) -> np.ndarray:
    return np.degrees(np.arctan2((v * east).sum(axis=0), (v * north).sum(axis=0)))


def direct(t: Triaxial, bet1, omg1, azi1, s12) -> dict[str, np.ndarray]:
    """bet2, omg2, azi2, m12, scale12, scale21 at the (signed) distance s12. NaN where an argument isn't finite or |bet1| > 90."""
    bet1, omg1, azi1, s12 = _columns(bet1, omg1, azi1, s12)
    good = np.isfinite(bet1 + omg1 + azi1 + s12) & (np.abs(bet1) <= 90)
    bet1, omg1, azi1, s12 = (np.where(good, x, 0.0) for x in (bet1, omg1, azi1, s12))
    r, east, north = frame(t, bet1, omg1)
    sa, ca = sincosd(azi1)
    y = shoot(t, r, east * sa + north * ca, s12)
    at = t._lines(y[:3] / np.sqrt(t.axes2[:, None]))
    _, east, north = frame(t, at["bet"], at["omg"])
    out = {"bet2": at["bet"], "omg2": at["omg"], "azi2": _azimuth(y[3:6], east, north), "m12": y[6], "scale12": y[8], "scale21": y[7]}
    return {n: np.where(good, x, np.nan) for n, x in out.items()}


def _turned(east: np.ndarray, north: np.ndarray, phi) -> np.ndarray:
    return east * np.sin(phi) + north * np.cos(phi)


def _misses(y: np.ndarray, w: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far r2 lies ahead of the state and to its right."""
    n = w * y[:3]
    n = n / np.sqrt((n * n).sum(axis=0))
    d = r2 - y[:3]
    return (d * y[3:6]).sum(axis=0), (d * np.cross(y[3:6], n, axis=0)).sum(axis=0)


def _aim(t: Triaxial, r1, east, north, r2, phi, s, rounds: int = 12):
    """Newton's method on azimuth and distance: (phi, s, state, miss), rows that have met their end being let go."""
    w = 1 / t.axes2[:, None]
    phi, s, miss = phi.copy(), s.copy(), np.full(phi.shape, np.inf)
    y = np.zeros((10, len(phi)))
    left = np.arange(len(phi))
    for turn in range(rounds):
        y[:, left] = shoot(t, r1[:, left], _turned(east[:, left], north[:, left], phi[left]), s[left])
        ahead, right = _misses(y[:, left], w, r2[:, left])
        miss[left] = np.sqrt(((y[:3, left] - r2[:, left]) ** 2).sum(axis=0))
        go = miss[left] > 2e-15 * t.a
        left, ahead, right = left[go], ahead[go], right[go]
        if not len(left) or turn == rounds - 1:
            break
        m = y[6, left]
        m = np.where(np.abs(m) > 1e-9 * t.a, m, 1e-9 * t.a)
        phi[left] += np.clip(right / m, -0.3, 0.3)
        s[left] = np.clip(s[left] + ahead, 0.0, 2 * np.pi * t.a)
    return phi, s, y, miss


def _sphere_start(t: Triaxial, r1, r2, east, north) -> tuple[np.ndarray, np.ndarray]:
    """Azimuth and length of the great circle of the sphere that the ellipsoid is stretched from."""
    axes = np.sqrt(t.axes2[:, None])
    u1, u2 = r1 / axes, r2 / axes
    across = np.cross(np.cross(u1, u2, axis=0), u1, axis=0)
    size = np.sqrt((across * across).sum(axis=0))
    flat = ~(size > 1e-12)
    across = np.where(flat, np.cross(np.cross(u1, np.array([[0.0], [0.0], [1.0]]), axis=0) + np.array([[0.0], [1e-3], [0.0]]), u1, axis=0), across)
    across /= np.sqrt((across * across).sum(axis=0))
    angle = np.arctan2(np.where(flat, 0.0, size), (u1 * u2).sum(axis=0))
    x, weight = np.polynomial.legendre.leggauss(16)
    s = np.zeros_like(angle)
    for xi, wi in zip((x + 1) / 2, weight / 2):
        s += wi * angle * np.sqrt(((axes * (across * np.cos(xi * angle) - u1 * np.sin(xi * angle))) ** 2).sum(axis=0))
    v = axes * across
    return np.arctan2((v * east).sum(axis=0), (v * north).sum(axis=0)), s


def _fan(t: Triaxial, r1, east, north, r2) -> tuple[np.ndarray, np.ndarray]:
    """The azimuth and length of the shortest line, for any rows: all azimuths are tried, each line's nearest pass is found, and between two
    neighbours that pass on different sides, so that lines are still apart (m > 0), the azimuth is halved in. Newton's method also starts from
    the states that come nearest; the shortest of all stands."""
    w, rows = 1 / t.axes2[:, None], r1.shape[1]
    phi = (np.arange(FAN) + 0.5) * (2 * np.pi / FAN)
    each = lambda x: np.repeat(x, FAN, axis=1)
    longest = np.pi * t.a * 1.02
    r, e, f, to, p = each(r1), each(east), each(north), each(r2), np.tile(phi, rows)
    states = shoot(t, r, _turned(e, f, p), np.full(r.shape[1], longest), keep=True)
    at = longest * np.arange(1, len(states) + 1) / len(states)
    near = ((states[:, :3] - to) ** 2).sum(axis=1).argmin(axis=0)

    def passes(lines, phi, s):
        """The miss to the right and the distance at the pass that is nearest s, by Newton's method."""
        y = shoot(t, r1[:, lines], _turned(east[:, lines], north[:, lines], phi), s)
        for _ in range(4):
            ahead, right = _misses(y, w, r2[:, lines])
            ahead = np.clip(ahead, -0.3 * t.c, 0.3 * t.c)
            y, s = shoot(t, y[:3], y[3:6], ahead), s + ahead
        return _misses(y, w, r2[:, lines])[1], s

    line = np.repeat(np.arange(rows), FAN)
    side, s = (x.reshape(rows, FAN) for x in passes(line, p, at[near]))
    nxt, s_nxt = np.roll(side, -1, axis=1), np.roll(s, -1, axis=1)
    i, j = np.nonzero((side >= 0) & (nxt < 0) & (np.abs(s - s_nxt) < 0.5 * t.c) & (np.maximum(np.abs(side), np.abs(nxt)) < 0.7 * t.c))
    low, high, f_low, f_high, s_at = phi[j], phi[j] + 2 * np.pi / FAN, side[i, j], nxt[i, j], (s[i, j] + s_nxt[i, j]) / 2
    for turn in range(24):
        straight = np.clip(f_low / np.where(f_low - f_high > 0, f_low - f_high, 1), 0.02, 0.98)
        middle = low + (high - low) * (straight if turn % 3 else 0.5)
        f, s_at = passes(i, middle, s_at)
        up = f >= 0
        low, f_low = np.where(up, middle, low), np.where(up, f, f_low)
        high, f_high = np.where(up, high, middle), np.where(up, f_high, f)
    best = np.full((2, rows), np.nan)
    middle = np.where(f_low <= -f_high, low, high)
    order = np.argsort(-s_at, kind="stable")  # the shortest is written last
    ok = s_at[order] > 0
    best[:, i[order][ok]] = np.stack([middle, s_at])[:, order[ok]]
    gap = np.where(states[:, 6] > 0, ((states[:, :3] - to) ** 2).sum(axis=1), np.inf)
    k = gap.argmin(axis=0).reshape(rows, FAN)
    start = np.argsort(gap.min(axis=0).reshape(rows, FAN), axis=1)[:, :4]
    row = np.repeat(np.arange(rows), 4)
    q, d, y, miss = _aim(t, r1[:, row], east[:, row], north[:, row], r2[:, row], phi[start].ravel(), at[np.take_along_axis(k, start, axis=1)].ravel())
    ok = (miss < 1e-12 * t.a) & (y[6] > 0) & ~(d > best[1, row] - 1e-9 * t.a)
    order = np.flatnonzero(ok)[np.argsort(-d[ok], kind="stable")]
    best[:, row[order]] = np.stack([q, d])[:, order]
    return best[0], best[1]


def inverse(t: Triaxial, bet1, omg1, bet2, omg2) -> dict[str, np.ndarray]:
    """s12, azi1, azi2, m12, scale12, scale21 of the shortest line. NaN where an argument isn't finite or a latitude is over 90.

    A line no longer than pi b c / a is the only shortest one (no curvature is over (a / (b c))^2). Newton's method from the sphere's great circle
    finds most lines; where it fails or its line is longer, a fan of all azimuths is followed. Of equal lines either may be given; for equal
    points s12 is 0 and azi1 = azi2 = 0. Where no line meets its end, which was seen only with axes as unequal as 3, 2, 1, the result is NaN.
    """
    bet1, omg1, bet2, omg2 = _columns(bet1, omg1, bet2, omg2)
    good = np.isfinite(bet1 + omg1 + bet2 + omg2) & (np.maximum(np.abs(bet1), np.abs(bet2)) <= 90)
    bet1, omg1, bet2, omg2 = (np.where(good, x, 0.0) for x in (bet1, omg1, bet2, omg2))
    r1, east, north = frame(t, bet1, omg1)
    r2, east2, north2 = frame(t, bet2, omg2)
    phi, s = _sphere_start(t, r1, r2, east, north)
    same = s <= 1e-15 * t.a
    phi, s, y, miss = _aim(t, r1, east, north, r2, phi, s)
    hard = np.flatnonzero(~same & ~((miss < 1e-12 * t.a) & (s < np.pi * t.b * t.c / t.a) & (y[6] > 0)))
    for part in np.array_split(hard, -(-len(hard) // ROWS)) if len(hard) else ():
        p, q = _fan(t, r1[:, part], east[:, part], north[:, part], r2[:, part])
        found = np.isfinite(p)
        part, p, q = part[found], p[found], q[found]
        if not len(part):
            continue
        p2, q2, y2, miss2 = _aim(t, r1[:, part], east[:, part], north[:, part], r2[:, part], p, q, 6)
        # beside a conjugate point Newton's step may leave; then the halved azimuth stays
        stay = ~(miss2 < 1e-9 * t.a) | (np.abs(q2 - q) > 1e-3 * t.a)
        y3 = shoot(t, r1[:, part], _turned(east[:, part], north[:, part], p), q)
        p2, q2, y2 = np.where(stay, p, p2), np.where(stay, q, q2), np.where(stay, y3, y2)
        better = ~(miss[part] < 1e-12 * t.a) | ~(y[6, part] > 0) | (q2 < s[part] + 1e-9 * t.a)
        part = part[better]
        phi[part], s[part], y[:, part] = p2[better], q2[better], y2[:, better]
    good &= same | (np.sqrt(((y[:3] - r2) ** 2).sum(axis=0)) < 1e-7 * t.a)
    v1 = _turned(east, north, phi)
    out = {"s12": s, "azi1": _azimuth(v1, east, north), "azi2": _azimuth(y[3:6], east2, north2), "m12": y[6], "scale12": y[8], "scale21": y[7]}
    for n, x in {"s12": 0.0, "azi1": 0.0, "azi2": 0.0, "m12": 0.0, "scale12": 1.0, "scale21": 1.0}.items():
        out[n] = np.where(good, np.where(same, x, out[n]), np.nan)
    return out
