"""NumPy kernels for geodesics, on arrays of points. Degrees and metres.

A geodesic is a great circle on the auxiliary sphere. Distance, longitude, reduced length and area are integrals over
its arc, taken here by Gauss-Legendre quadrature. The inverse problem finds the azimuth at the first point by Newton's
method inside a bracket, on the longitude that it gives, which grows with it. No series in the flattening is used, so
any moderately flattened ellipsoid, oblate or prolate, is served by the same code.
"""

from __future__ import annotations

import numpy as np

from .ellipsoid import WGS84, Ellipsoid

NODES, WEIGHTS = np.polynomial.legendre.leggauss(12)
PANELS, ROUNDS = 2, 120


def _long_rule() -> tuple[np.ndarray, np.ndarray]:
    """The nodes and weights in long doubles, by Newton's method on the Legendre polynomial."""
    x, n = NODES.astype(np.longdouble), len(NODES)
    for _ in range(3):
        before, p = np.ones_like(x), x
        for k in range(2, n + 1):
            before, p = p, ((2 * k - 1) * x * p - (k - 1) * before) / k
        slope = n * (x * p - before) / (x * x - 1)
        x = x - p / slope
    return x, 2 / ((1 - x * x) * slope * slope)


LONG_NODES, LONG_WEIGHTS = _long_rule()


def integral(g, low: np.ndarray, high: np.ndarray, panels: int = PANELS) -> np.ndarray:
    """Of g(sigma, row axis first), between low and high; of long doubles, in long doubles."""
    nodes, weights = (LONG_NODES, LONG_WEIGHTS) if np.result_type(low, high) == np.longdouble else (NODES, WEIGHTS)
    total, width = np.zeros_like(low), (high - low) / panels
    for k in range(panels):
        mid = low + (k + 0.5) * width
        total += (g(mid[:, None] + nodes * width[:, None] / 2) * weights).sum(axis=1) * width / 2
    return total


def sincosd(x) -> tuple[np.ndarray, np.ndarray]:
    """Sine and cosine of degrees, exact at multiples of 90. A sine of zero has the sign of x, a cosine of zero is positive."""
    x = np.asarray(x)
    x = x if x.dtype == np.longdouble else x.astype(np.float64)
    r = np.fmod(x, 360.0)
    q = np.rint(r / 90)
    t = np.radians(r - 90 * q)
    s, c = np.sin(t), np.cos(t)
    q = np.where(np.isfinite(q), q, 0).astype(int) % 4
    s, c = np.choose(q, [s, c, -s, -c]), np.choose(q, [c, -s, -c, s])
    return np.where(s == 0, np.copysign(0.0, x), s), c + 0.0


def normalized(x) -> np.ndarray:
    """Degrees in [-180, 180]; 180 has the sign of x."""
    x = np.asarray(x, np.float64)
    r = np.fmod(x, 360.0)
    return np.where(r > 180, r - 360, np.where(r < -180, r + 360, r))


def two_sum(u, v) -> tuple[np.ndarray, np.ndarray]:
    """u + v as a double, and what that leaves out."""
    s = u + v
    up = s - v
    vpp = s - up
    return s, (u - up) + (v - vpp)


def difference(x, y) -> np.ndarray:
    """y - x in [-180, 180]; where it is 0 or 180, with the sign of the exact difference."""
    d, left = two_sum(normalized(-np.asarray(x, np.float64)), normalized(y))
    d, left = two_sum(normalized(d), left)
    ends = (d == 0) | (np.abs(d) == 180)
    return np.where(ends, np.copysign(d, np.where(left == 0, np.asarray(y, np.float64) - x, -left)), d)


class Arc:
    """Geodesics through points of reduced latitude with sine sb, cosine cb, at azimuths of sine sa, cosine ca."""

    def __init__(self, sb, cb, sa, ca, e: Ellipsoid):
        self.e = e
        self.s0, self.c0 = sa * cb, np.hypot(ca, sa * sb)
        self.sigma1 = np.arctan2(sb, ca * cb)
        self.omega1 = np.arctan2(self.s0 * sb, ca * cb)
        self.alpha1 = np.arctan2(sa, ca)
        self.k2 = e.e2 / (1 - e.e2) * self.c0**2

    def root(self, sigma):
        return np.sqrt(1 + self.k2.reshape(-1, *[1] * (np.ndim(sigma) - 1)) * np.sin(sigma) ** 2)

    def distance(self, sigma):
        return self.e.b * integral(self.root, self.sigma1, sigma)

    def arc(self, s12):
        """The arc at which the distance from the first point is s12."""
        sigma = self.sigma1 + s12 / (self.e.b * np.sqrt(1 + self.k2 / 2))
        for _ in range(8):
            step = (s12 - self.distance(sigma)) / (self.e.b * self.root(sigma))
            sigma = sigma + step
            if not np.nanmax(np.abs(step), initial=0) > 1e-16 * np.pi:
                break
        return sigma

    def omega(self, sigma):
        """Longitude on the sphere from the node, not reduced."""
        turn = np.floor((sigma + np.pi) / (2 * np.pi)) * 2 * np.pi
        return np.arctan2(self.s0 * np.sin(sigma), np.cos(sigma)) + np.copysign(1.0, self.s0) * turn

    def longitude(self, sigma):
        """Radians of longitude from the first point, not reduced."""
        f = self.e.f
        back = integral(lambda s: (2 - f) / (1 + (1 - f) * self.root(s)), self.sigma1, sigma)
        return self.omega(sigma) - self.omega1 - f * self.s0 * back

    def scales(self, sigma, panels: int = PANELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Reduced length m12 and the geodesic scales at both ends."""
        k2 = self.k2[:, None]
        s1, c1, s2, c2 = np.sin(self.sigma1), np.cos(self.sigma1), np.sin(sigma), np.cos(sigma)
        r1, r2 = self.root(self.sigma1), self.root(sigma)
        j = integral(lambda s: k2 * np.sin(s) ** 2 / np.sqrt(1 + k2 * np.sin(s) ** 2), self.sigma1, sigma, panels)
        m = self.e.b * ((r2 * (c1 * s2) - r1 * (s1 * c2)) - c1 * c2 * j)
        bend, turned = self.k2 * (s2 - s1) * (s2 + s1) / (r1 + r2), np.cos(sigma - self.sigma1)
        return m, turned + (bend * s2 - c2 * j) * s1 / r1, turned - (bend * s1 - c1 * j) * s2 / r2

    def area(self, sigma, turn):
        """Between the arc and the equator, with ``turn`` the change of azimuth in radians."""
        e = self.e
        if e.e2 == 0:
            return e.authalic2 * turn
        ep2 = e.e2 / (1 - e.e2)

        def t(x):
            """x + sqrt(1 / x + 1) * asinh(sqrt(x)), also below zero."""
            y = np.sqrt(np.maximum(np.abs(x), 1e-30))
            return x + np.where(x >= 0, np.sqrt(1 + x) * np.arcsinh(y) / y, np.sqrt(1 + x) * np.arcsin(np.minimum(y, 1)) / y)

        def slope(x):
            y = np.sqrt(np.maximum(np.abs(x), 1e-30))
            bulge = np.where(x >= 0, np.arcsinh(y), np.arcsin(np.minimum(y, 1))) / y
            return 1 + (1 / x) * (0.5 - bulge / (2 * np.sqrt(1 + x)))

        def g(s):
            x = self.k2[:, None] * np.sin(s) ** 2
            gap = ep2 - x
            near = np.abs(gap) < 1e-9 * abs(ep2)
            return np.where(near, slope(np.float64(ep2)), (t(np.float64(ep2)) - t(x)) / np.where(near, 1, gap)) * np.sin(s) / 2

        return e.authalic2 * turn - e.e2 * e.a**2 * self.c0 * self.s0 * integral(g, self.sigma1, sigma)

    def at(self, sigma):
        """Sine and cosine of reduced latitude and of azimuth."""
        ss, cs = np.sin(sigma), np.cos(sigma)
        return self.c0 * ss, np.hypot(self.s0, self.c0 * cs), self.s0, self.c0 * cs


def reduced(lat, e: Ellipsoid):
    """Sine and cosine of the reduced latitude; the cosine is never 0."""
    s, c = sincosd(lat)
    s = s * (1 - e.f)
    h = np.hypot(s, c)
    return s / h, np.maximum(c / h, 1e-150)


#: What the two problems give.
DIRECT = ("lat2", "lon2", "azi2", "s12", "a12", "m12", "scale12", "scale21", "area12")
INVERSE = ("s12", "a12", "azi1", "azi2", "m12", "scale12", "scale21", "area12")


def _columns(*values) -> list[np.ndarray]:
    return [np.array(v, np.float64) for v in np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, np.float64)) for v in values))]


def direct(lat1, lon1, azi1, s12, e: Ellipsoid = WGS84, arc: bool = False, unroll: bool = False, fields=DIRECT) -> dict[str, np.ndarray]:
    """The point at a distance s12 (with ``arc``, at so many degrees of arc on the auxiliary sphere) along a geodesic.

    lon2 is in [-180, 180] or, with ``unroll``, lon1 and the way gone. ``fields`` are those of DIRECT to give.
    """
    lat1, lon1, azi1, s12 = _columns(lat1, lon1, azi1, s12)
    lat1 = np.where(np.abs(lat1) <= 90, lat1, np.nan)
    line = Arc(*reduced(lat1, e), *sincosd(normalized(azi1)), e)
    return _position(line, lon1, s12, arc, unroll, fields)


def _position(line: Arc, lon1, s12, arc: bool, unroll: bool, fields) -> dict[str, np.ndarray]:
    e = line.e
    sigma = line.sigma1 + np.radians(s12) if arc else line.arc(s12)
    sb, cb, sa, ca = line.at(sigma)
    out = {"lat2": np.degrees(np.arctan2(sb, (1 - e.f) * cb)), "azi2": np.degrees(np.arctan2(sa, ca))}
    if "lon2" in fields:
        way = np.degrees(line.longitude(sigma))
        out["lon2"] = lon1 + way if unroll else normalized(normalized(lon1) + normalized(way))
    out["s12"] = (line.distance(sigma) if arc else s12) if "s12" in fields else s12
    out["a12"] = s12 if arc else np.degrees(sigma - line.sigma1)
    if {"m12", "scale12", "scale21"} & set(fields):
        out["m12"], out["scale12"], out["scale21"] = line.scales(sigma)
    if "area12" in fields:
        out["area12"] = line.area(sigma, np.arctan2(sa, ca) - line.alpha1)
    return {k: out[k] for k in fields}


class GeodesicLine:
    """Geodesics fixed by a point and an azimuth, or by two points; positions along them by distance or by arc.

    ``distance`` and ``arc`` are those of a third point, if one is set (by two points: the second).
    """

    def __init__(self, lat1, lon1, azi1, e: Ellipsoid = WGS84):
        self.lat1, self.lon1, self.azi1 = _columns(lat1, lon1, azi1)
        self.azi1 = normalized(self.azi1)
        self.line = Arc(*reduced(np.where(np.abs(self.lat1) <= 90, self.lat1, np.nan), e), *sincosd(self.azi1), e)
        self.distance = self.arc = np.full_like(self.lat1, np.nan)

    @classmethod
    def between(cls, lat1, lon1, lat2, lon2, e: Ellipsoid = WGS84) -> GeodesicLine:
        found = inverse(lat1, lon1, lat2, lon2, e, fields=("azi1", "s12"))
        lat1, lon1, azi1 = np.broadcast_arrays(np.atleast_1d(lat1), np.atleast_1d(lon1), found["azi1"])
        return cls(lat1, lon1, azi1, e).set_distance(found["s12"])

    def set_distance(self, s13) -> GeodesicLine:
        self.distance = np.broadcast_to(np.asarray(s13, np.float64), self.lat1.shape)
        self.arc = np.degrees(self.line.arc(self.distance) - self.line.sigma1)
        return self

    def set_arc(self, a13) -> GeodesicLine:
        self.arc = np.broadcast_to(np.asarray(a13, np.float64), self.lat1.shape)
        self.distance = self.line.distance(self.line.sigma1 + np.radians(self.arc))
        return self

    @property
    def equatorial_azimuth(self) -> np.ndarray:
        """The azimuth where the line crosses the equator northward."""
        return np.degrees(np.arctan2(self.line.s0, self.line.c0))

    @property
    def equatorial_arc(self) -> np.ndarray:
        """Degrees of arc from that crossing to the first point."""
        return np.degrees(self.line.sigma1)

    def position(self, s12, arc: bool = False, unroll: bool = False, fields=DIRECT) -> dict[str, np.ndarray]:
        return _position(self.line, self.lon1, np.broadcast_to(np.asarray(s12, np.float64), self.lat1.shape), arc, unroll, fields)


def _solve(sb1, cb1, sb2, cb2, goal, e: Ellipsoid) -> np.ndarray:
    """The azimuth (radians) at the first point, the farther one from the equator and in the south, whose geodesic reaches the longitude ``goal``."""
    alpha = np.arctan2(cb2 * np.sin(goal), cb1 * sb2 - sb1 * cb2 * np.cos(goal))
    low, high = np.zeros_like(goal), np.full_like(goal, np.pi)
    best, least = alpha.copy(), np.full_like(goal, np.inf)
    todo = np.arange(len(goal))
    for k in range(ROUNDS):
        a = alpha[todo]
        a = np.where((a > low[todo]) & (a < high[todo]), a, (low[todo] + high[todo]) / 2)
        line, sigma2, ca2 = _reach(sb1[todo], cb1[todo], sb2[todo], cb2[todo], a, e)
        gap = line.longitude(sigma2) - goal[todo]
        better, halved = np.abs(gap) < least[todo], np.abs(gap) < least[todo] / 2
        best[todo[better]], least[todo[better]] = a[better], np.abs(gap[better])
        under = gap < 0
        before = high[todo] - low[todo]
        low[todo[under]], high[todo[~under]] = a[under], a[~under]
        width = high[todo] - low[todo]
        m = line.scales(sigma2, 1)[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(ca2 > 0, m / (e.a * ca2 * cb2[todo]), np.inf)
            step = a - gap / slope
        # a step that leaves the bracket is taken to be its middle; so is one after which neither gap nor bracket has halved
        slow = ~halved & (width > before / 2)
        alpha[todo] = np.where(slow | ~np.isfinite(step), (low[todo] + high[todo]) / 2, step)
        still = (np.abs(gap) > (2e-16 if k < 3 else 1.8e-15)) & (width > 2e-16 * np.maximum(a, 1e-3)) & (np.abs(alpha[todo] - a) > 1e-16 * a)
        todo = todo[still]
        if not len(todo):
            break
    return best


def _reach(sb1, cb1, sb2, cb2, alpha, e: Ellipsoid) -> tuple[Arc, np.ndarray, np.ndarray]:
    """The geodesic at that azimuth, its arc at the second latitude going north, and the cosine of the azimuth there."""
    line = Arc(sb1, cb1, np.sin(alpha), np.cos(alpha), e)
    ca2 = np.sqrt(np.maximum((np.cos(alpha) * cb1) ** 2 + np.where(cb1 < -sb1, (cb2 - cb1) * (cb1 + cb2), (sb1 - sb2) * (sb1 + sb2)), 0)) / cb2
    sigma2 = np.arctan2(sb2, ca2 * cb2)
    return line, np.where(sigma2 < line.sigma1 - 1, sigma2 + 2 * np.pi, sigma2), ca2


def inverse(lat1, lon1, lat2, lon2, e: Ellipsoid = WGS84, fields=INVERSE) -> dict[str, np.ndarray]:
    """The shortest geodesics between points; ``fields`` are those of INVERSE to give. NaN where a coordinate is none.

    Of two shortest ways, that goes north which starts at a latitude that is positive, +0 included; between points 180
    degrees apart it goes east if the difference of longitudes is +180. area12 is the area under the geodesic.
    """
    lat1, lon1, lat2, lon2 = _columns(lat1, lon1, lat2, lon2)
    bad = ~(np.isfinite(lat1 + lon1 + lat2 + lon2) & (np.abs(lat1) <= 90) & (np.abs(lat2) <= 90))
    lat1, lon1, lat2, lon2 = (np.where(bad, 0.0, v) for v in (lat1, lon1, lat2, lon2))
    lam = difference(lon1, lon2)
    west, goal = np.signbit(lam), np.radians(np.abs(lam))
    # the first point is taken to be the one farther from the equator, in the south: then the azimuth's range is all of [0, 180]
    swap = np.abs(lat1) < np.abs(lat2)
    p1, p2 = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    north = ~np.signbit(p1)
    p1, p2 = np.where(north, -p1, p1), np.where(north, -p2, p2)
    (sb1, cb1), (sb2, cb2) = reduced(p1, e), reduced(p2, e)
    equator = (p1 == 0) & (p2 == 0) & (goal > 0) & (goal <= (1 - e.f) * np.pi)
    along = ((goal == 0) | (np.abs(lam) == 180) | (p1 == -90)) & ~equator  # a meridian, if it is the shortest
    alpha = np.where(equator, np.pi / 2, np.where(np.abs(lam) == 180, np.pi, goal * (p1 == -90)))
    if along.any():
        line, sigma2, _ = _reach(sb1, cb1, sb2, cb2, alpha, e)
        along &= (sigma2 - line.sigma1 < 1) | (line.scales(sigma2)[0] >= 0)
    rest = np.flatnonzero(~along & ~equator)
    alpha[rest] = _solve(sb1[rest], cb1[rest], sb2[rest], cb2[rest], goal[rest], e)
    line, sigma2, ca2 = _reach(sb1, cb1, sb2, cb2, alpha, e)
    # azimuths by exact sines: those of meridians are 0 or 180
    sa1, ca1 = np.where(along & (p1 > -90), 0.0, np.sin(alpha)), np.where(equator, 0.0, np.cos(alpha))
    azi1, azi2 = np.arctan2(sa1, ca1), np.where(equator, np.pi / 2, np.arctan2(sa1 * cb1, ca2 * cb2))
    sigma12 = sigma2 - line.sigma1
    out = {"s12": np.where(equator, e.a * goal, np.maximum(line.distance(sigma2), 0.0)), "a12": np.degrees(np.where(equator, goal / (1 - e.f), sigma12))}
    if {"m12", "scale12", "scale21"} & set(fields):
        m, one, two = line.scales(sigma2)
        turned = goal / (1 - e.f)
        m, one, two = np.where(equator, e.b * np.sin(turned), m), np.where(equator, np.cos(turned), one), np.where(equator, np.cos(turned), two)
        out |= {"m12": m, "scale12": np.where(swap, two, one), "scale21": np.where(swap, one, two)}
    if "area12" in fields:
        omega12 = np.where(along, goal, line.omega(sigma2) - line.omega1)
        t1, t2 = sb1 / (1 + cb1), sb2 / (1 + cb2)
        small = (np.cos(omega12) > -0.7071) & (sb2 - sb1 < 1.75)
        # the excess by half angles, or by azimuths where those are better
        turn = np.where(small, 2 * np.arctan2(np.tan(np.where(small, omega12, 0) / 2) * (t1 + t2), 1 + t1 * t2), azi2 - azi1)
        turn = np.where((goal == 0) & (p1 > -90), 0.0, turn)
        both = np.where(p1 == -90, 0.0, line.area(sigma2, 0.0 * turn))
        area = np.where(equator, 0.0, e.authalic2 * turn + both)
        out["area12"] = np.where(north ^ west, -area, area) + 0.0
    # undo the turns: south to north, then the ends' order, then west
    azi1, azi2 = np.where(north, np.pi - azi1, azi1), np.where(north, np.pi - azi2, azi2)
    azi1, azi2 = np.where(swap, np.pi - azi2, azi1), np.where(swap, np.pi - azi1, azi2)
    out |= {"azi1": np.degrees(np.where(west, -azi1, azi1)), "azi2": np.degrees(np.where(west, -azi2, azi2))}
    return {k: np.where(bad, np.nan, out[k]) for k in fields}


#: The longest arc on the auxiliary sphere, in radians, that short_distance takes.
SHORT = 0.16


def short_distance(sb1, cb1, sb2, cb2, lam, e: Ellipsoid) -> np.ndarray:
    """s12 alone, of points at most SHORT apart, by sines and cosines of reduced latitudes and the radians of longitude between them, pi at most.

    The spherical longitude of an Arc is found as a fixed point, by Newton's method with the slope of short arcs: three
    steps are full accuracy. Its integrals are sums over pairs of nodes about the middle of the arc.
    """
    f, ep2, both, up = e.f, e.e2 / (1 - e.e2), cb1 * cb2, sb2 * cb1 - cb2 * sb1
    lam = np.abs(lam)

    def roots(w, rule):
        """sin(alpha0), the arc, and (weight, root) at nodes of a rule on [-1, 1]; those below zero are met by their sign."""
        sh, ch = np.sin(w / 2), np.cos(w / 2)
        sinw, versed = 2 * sh * ch, 2 * sh * sh
        u, v = cb2 * sinw, up + sb1 * cb2 * versed
        ss = np.sqrt(u * u + v * v)
        arc = np.arcsin(np.minimum(ss, 1.0))
        s0 = np.where(ss > 0, both * sinw / np.maximum(ss, 1e-300), 0.0)
        c2 = np.maximum(1 - s0 * s0, 0.0)
        q = c2 * np.sqrt(np.maximum(1 - ss * ss, 0.0)) - 2 * sb1 * sb2
        r = np.sqrt(np.maximum(c2 * c2 - q * q, 0.0))
        at = []
        for t, weight in zip(*np.polynomial.legendre.leggauss(rule)):
            if t > 1e-9:
                even, odd = c2 - q * np.cos(t * arc), r * np.sin(t * arc)
                at += [(weight, np.sqrt(1 + ep2 / 2 * (even + odd))), (weight, np.sqrt(1 + ep2 / 2 * (even - odd)))]
            elif t > -1e-9:
                at.append((weight, np.sqrt(1 + ep2 / 2 * (c2 - q))))
        return s0, arc, at

    slope = 1 - f * both
    w = lam / slope
    for _ in range(3):
        s0, arc, at = roots(w, 3)
        back = sum(weight * ((2 - f) / (1 + (1 - f) * root)) for weight, root in at) * arc / 2
        w = w + (lam + f * s0 * back - w) / slope
    _, arc, at = roots(w, 4)
    return e.b * sum(weight * root for weight, root in at) * arc / 2
