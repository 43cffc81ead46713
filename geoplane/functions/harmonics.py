"""Spherical harmonic sums with gradients, normal gravity, and models of gravity, the magnetic field and the geoid, on arrays of points."""

from __future__ import annotations

import io
import math
import struct
from dataclasses import dataclass, field

import numpy as np

from .ellipsoid import WGS84, Ellipsoid
from .geodesic import _columns, normalized, sincosd


def size_of(degree: int, order: int) -> int:
    """Cosine coefficients up to a degree and an order, a column for each order."""
    return (order + 1) * (2 * degree - order + 2) // 2


@dataclass
class Coefficients:
    """Cosine and sine coefficients [degree, order]; orders can end before degrees do."""

    c: np.ndarray
    s: np.ndarray

    @classmethod
    def read(cls, stream: io.BufferedIOBase, degree: int | None = None, order: int | None = None) -> Coefficients:
        """A block: degree and order (32-bit), then the cosines and the sines (from order 1), a column for each order, little-endian.

        Degrees and orders above ``degree`` and ``order`` are passed over.
        """
        n, m = struct.unpack("<ii", stream.read(8))
        if n < 0:
            return cls(np.zeros((1, 1)), np.zeros((1, 1)))
        count = size_of(n, m)
        cosines, sines = (np.frombuffer(stream.read(8 * k), "<f8") for k in (count, count - (n + 1)))
        top = n if degree is None else min(n, degree)
        last = min(m if order is None else min(m, order), top)
        c, s = np.zeros((top + 1, last + 1)), np.zeros((top + 1, last + 1))
        for j in range(last + 1):
            at = size_of(n, j - 1) if j else 0
            c[j:, j] = cosines[at : at + top - j + 1]
            if j:
                s[j:, j] = sines[at - (n + 1) : at - (n + 1) + top - j + 1]
        return cls(c, s)

    def written(self) -> bytes:
        n, m = len(self.c) - 1, self.c.shape[1] - 1
        column = lambda a, first: b"".join(a[j:, j].astype("<f8").tobytes() for j in range(first, m + 1))
        return struct.pack("<ii", n, m) + column(self.c, 0) + column(self.s, 1)

    def plus(self, other: Coefficients, times: float = 1.0) -> Coefficients:
        """The sum with some multiple of other coefficients, of any degree and order."""
        shape = tuple(max(v) for v in zip(self.c.shape, other.c.shape))
        wide = lambda a: np.pad(a, [(0, n - k) for n, k in zip(shape, a.shape)])
        return Coefficients(wide(self.c) + times * wide(other.c), wide(self.s) + times * wide(other.s))


#: Legendre functions without their power of the sine go up to 1e450 at degree 2190; they are kept at this power of two below.
SHIFT = 930
#: Numbers of a block of circles, an array for each of the running sums.
BLOCK = 1_000_000


class Circles:
    """Sums over degrees on circles (distance p from the axis, height z): what is left is a Fourier sum over longitude.

    For each order there are a cosine and a sine coefficient of the value and of its derivatives along the radius,
    southward and eastward. Legendre functions are u ** m times polynomials of t, which go up by degree for all orders
    at once, with their derivatives by t; the power of u comes last, mantissa and exponent apart, so that nothing
    underflows before its time and poles are no special case.
    """

    def __init__(self, k: Coefficients, radius, p: np.ndarray, z: np.ndarray, schmidt: bool = False):
        self.r = np.hypot(p, z)
        self.t, self.u = z / self.r, p / self.r
        q = (radius / self.r)[:, None]
        t, tall, wide = self.t[:, None], len(k.c), k.c.shape[1]
        m = np.arange(wide)
        value, slope = np.zeros((2, len(p), wide)), np.zeros((2, len(p), wide))  # this degree's and the one's before
        sums = np.zeros((6, len(p), wide))  # cosine and sine of value, radial derivative, derivative by t
        diagonal = np.ldexp(1.0, -SHIFT) * q[:, 0]
        for n in range(tall):
            o = m[: min(n, wide)]  # orders that go on
            new, new_slope = np.zeros((len(p), wide)), np.zeros((len(p), wide))
            if n:
                a = np.sqrt((2 * n - 1) * (2 * n + 1) / ((n - o) * (n + o))) * q
                b = np.sqrt((2 * n + 1) * (n + o - 1.0) * (n - o - 1.0) / ((n - o) * (n + o) * max(2 * n - 3, 1))) * q * q
                w = len(o)
                new[:, :w] = a * t * value[0, :, :w] - b * value[1, :, :w]
                new_slope[:, :w] = a * (value[0, :, :w] + t * slope[0, :, :w]) - b * slope[1, :, :w]
                diagonal = diagonal * q[:, 0] * math.sqrt(3 if n == 1 else (2 * n + 1) / (2 * n))
            if n < wide:
                new[:, n] = diagonal
            value, slope = np.stack([new, value[0]]), np.stack([new_slope, slope[0]])
            scale = 1 / math.sqrt(2 * n + 1) if schmidt else 1.0
            for part, row in enumerate((k.c[n], k.s[n])):
                if row.any():
                    term = scale * row * new
                    sums[part] += term
                    sums[2 + part] -= (n + 1) * term
                    sums[4 + part] += scale * row * new_slope
        self._with_powers(sums, wide)

    def _with_powers(self, sums: np.ndarray, wide: int) -> None:
        f, e = np.empty((len(self.u), wide + 1)), np.empty((len(self.u), wide + 1), int)
        now, power = np.ones_like(self.u), np.zeros(len(self.u), int)
        for m in range(wide + 1):
            f[:, m], e[:, m] = now, power
            now, more = np.frexp(now * self.u)
            power = power + more
        m = np.arange(wide)
        whole = lambda x, k: np.ldexp(x * f[:, k], e[:, k] + SHIFT)
        below = np.maximum(m - 1, 0)
        self.value, self.radial = ([whole(x, m) for x in sums[i : i + 2]] for i in (0, 2))
        self.east = [m * whole(x, below) for x in sums[0:2]]
        self.south = [self.t[:, None] * x - whole(d, m + 1) for x, d in zip(self.east, sums[4:6])]

    def at(self, circle: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> dict[str, np.ndarray]:
        """v, gx, gy, gz at points of circles, by their number and their longitudes' cosines and sines."""
        out = np.empty((4, len(circle)))
        wide = self.value[0].shape[1]
        for a in range(0, len(circle), max(1, BLOCK // wide)):
            on = slice(a, a + max(1, BLOCK // wide))
            turn = np.angle(cos[on] + 1j * sin[on])[:, None] * np.arange(wide)
            c, s = np.cos(turn), np.sin(turn)
            i = circle[on]
            total = lambda x, y: np.einsum("ij,ij->i", x[i], c) + np.einsum("ij,ij->i", y[i], s)
            out[:, on] = total(*self.value), total(*self.radial), total(*self.south), total(self.east[1], -self.east[0])
        r, t, u = self.r[circle], self.t[circle], self.u[circle]
        gr, gt, gl = out[1] / r, out[2] / r, out[3] / r
        gp = gr * u + gt * t
        return {"v": out[0], "gx": gp * cos - gl * sin, "gy": gp * sin + gl * cos, "gz": gr * t - gt * u}


def harmonic_sum(k: Coefficients, radius, x, y, z, schmidt: bool = False, circle=None) -> dict[str, np.ndarray]:
    """v and its gradient gx, gy, gz: the sum of (radius / r) ** (n + 1) (C cos m lon + S sin m lon) P_nm, fully normalised or by Schmidt.

    ``circle`` numbers the circles that points are on (by latitude and height): sums over degrees are worked out once a
    circle, so that a point costs as much as there are orders. Without it each point has a circle of its own.
    """
    x, y, z = _columns(x, y, z)
    p = np.hypot(x, y)
    on = p > 0
    cos, sin = np.where(on, x / np.where(on, p, 1), 1.0), np.where(on, y / np.where(on, p, 1), 0.0)
    first, number = (np.arange(len(x)),) * 2 if circle is None else np.unique(circle, return_index=True, return_inverse=True)[1:]
    radius = np.broadcast_to(np.asarray(radius, np.float64), p.shape)
    out = {c: np.empty(len(x)) for c in ("v", "gx", "gy", "gz")}
    order = np.argsort(number, kind="stable")
    step = max(1, BLOCK // k.c.shape[1])
    for a in range(0, len(first), step):
        own = first[a : a + step]
        here = order[np.searchsorted(number[order], a) : np.searchsorted(number[order], a + step)]
        got = Circles(k, radius[own], p[own], z[own], schmidt).at(number[here] - a, cos[here], sin[here])
        for c, v in got.items():
            out[c][here] = v
    return out


def circles_of(*columns) -> np.ndarray:
    """Numbers of the circles of latitude that points are on, by the columns that tell them (NaN like any value)."""
    return np.unique(np.stack(columns), axis=1, return_inverse=True, equal_nan=False)[1].reshape(-1)


def _frame(lat, lon, h, e: Ellipsoid):
    """Geocentric x, y, z, and the rows of the rotation to east, north, up."""
    (sp, cp), (sl, cl) = sincosd(lat), sincosd(lon)
    n = e.a / np.sqrt(1 - e.e2 * sp * sp)
    xyz = (n + h) * cp * cl, (n + h) * cp * sl, ((1 - e.e2) * n + h) * sp
    zero = np.zeros_like(sp)
    return xyz, ((-sl, cl, zero), (-sp * cl, -sp * sl, cp), (cp * cl, cp * sl, sp))


def _turned(rows, g) -> list[np.ndarray]:
    return [sum(a * b for a, b in zip(row, g)) for row in rows]


@dataclass(frozen=True)
class NormalGravity:
    """The field of an ellipsoid that is a level surface: mass constant gm, angular velocity omega. Oblate only."""

    e: Ellipsoid = WGS84
    gm: float = 3.986004418e14
    omega: float = 7.292115e-5

    @property
    def _linear(self) -> float:
        return self.e.a * math.sqrt(self.e.e2)

    @staticmethod
    def _q(t):
        """((1 + 3 / t^2) atan t - 3 / t) / 2, t = E / u."""
        small = np.abs(t) < 0.3
        k = np.arange(1, 30)
        series = sum(float((-1) ** (i + 1) * 2 * i / ((2 * i + 1) * (2 * i + 3))) * np.where(small, t, 0.0) ** (2 * i + 1) for i in k)
        w = np.where(small, 1.0, t)
        return np.where(small, series, ((1 + 3 / w**2) * np.arctan(w) - 3 / w) / 2)

    @staticmethod
    def _q1(t):
        """3 (1 + 1 / t^2) (1 - atan t / t) - 1."""
        small = np.abs(t) < 0.3
        series = sum(float(6 * (-1) ** (i + 1) / ((2 * i + 1) * (2 * i + 3))) * np.where(small, t, 0.0) ** (2 * i) for i in range(1, 30))
        w = np.where(small, 1.0, t)
        return np.where(small, series, 3 * (1 + 1 / w**2) * (1 - np.arctan(w) / w) - 1)

    @property
    def constants(self) -> dict[str, float]:
        """u0 (potential of the surface), gamma_e, gamma_p (gravity at the equator and the poles), j2."""
        a, b, lin = self.e.a, self.e.b, self._linear
        t = np.float64(lin / b)
        m = self.omega**2 * a**2 * b / self.gm
        ratio = float(t * self._q1(t) / self._q(t))
        return {
            "u0": self.gm / lin * math.atan(lin / b) + self.omega**2 * a**2 / 3, "gamma_e": self.gm / (a * b) * (1 - m - m / 6 * ratio), "gamma_p": self.gm / a**2 * (1 + m / 3 * ratio),
            "j2": self.e.e2 / 3 * (1 - 2 / 15 * m * float(t) / float(self._q(t))),
        }

    @classmethod
    def from_j2(cls, a: float, gm: float, omega: float, j2: float) -> NormalGravity:
        """The ellipsoid whose dynamical form factor is j2."""
        f = 1.5 * j2 + 0.5 * omega**2 * a**3 / gm
        for _ in range(60):
            one = cls(Ellipsoid(a, f), gm, omega)
            f += 1.5 * (j2 - one.constants["j2"])
        return cls(Ellipsoid(a, f), gm, omega)

    def surface(self, lat) -> np.ndarray:
        """Gravity on the ellipsoid."""
        s, _ = sincosd(np.atleast_1d(lat))
        k = self.constants
        return (k["gamma_e"] + (self.e.b / self.e.a * k["gamma_p"] - k["gamma_e"]) * s * s) / np.sqrt(1 - self.e.e2 * s * s)

    def at(self, x, y, z) -> dict[str, np.ndarray]:
        """u (potential with the centrifugal one), gx, gy, gz."""
        x, y, z = _columns(x, y, z)
        lin, a = self._linear, self.e.a
        p2 = x * x + y * y
        d = p2 + z * z - lin**2
        u2 = (d + np.sqrt(d * d + 4 * lin**2 * z * z)) / 2
        u, w2 = np.sqrt(u2), u2 + lin**2
        sb, cb = z / u, np.sqrt(p2 / w2)
        norm = np.hypot(sb, cb)
        sb, cb = sb / norm, cb / norm
        t, t0 = lin / u, np.float64(lin / self.e.b)
        q, q1, q0 = self._q(t), self._q1(t), float(self._q(t0))
        w = np.sqrt((u2 + lin**2 * sb**2) / w2)
        spin = self.omega**2
        pot = self.gm / lin * np.arctan2(lin, u) + spin * a**2 * q / q0 * (sb**2 - 1 / 3) / 2 + spin * w2 * cb**2 / 2
        gu = (-(self.gm + spin * a**2 * lin * q1 / q0 * (sb**2 / 2 - 1 / 6)) / w2 + spin * u * cb**2) / w
        gb = (spin * a**2 * q / q0 / np.sqrt(w2) - spin * np.sqrt(w2)) * sb * cb / w
        gp = u / (w * np.sqrt(w2)) * cb * gu - sb / w * gb
        cl, sl = np.where(p2 > 0, x / np.sqrt(np.where(p2 > 0, p2, 1)), 1.0), np.where(p2 > 0, y / np.sqrt(np.where(p2 > 0, p2, 1)), 0.0)
        return {"u": pot, "gx": gp * cl, "gy": gp * sl, "gz": sb / w * gu + cb * u / (w * np.sqrt(w2)) * gb}

    def gravity(self, lat, h) -> dict[str, np.ndarray]:
        """u, north, up."""
        lat, h = _columns(lat, h)
        xyz, rows = _frame(lat, 0.0 * lat, h, self.e)
        g = self.at(*xyz)
        _, north, up = _turned(rows, (g["gx"], g["gy"], g["gz"]))
        return {"u": g["u"], "north": north, "up": up}


def key_values(text: str, comment: str = "#") -> dict[str, str]:
    """Lines ``key value`` or ``key = value``, comments left out."""
    out = {}
    for line in text.splitlines():
        words = line.split(comment)[0].replace("=", " ", 1).split(None, 1) if comment not in line or line.split(comment)[0].strip() else []
        if words:
            out[words[0]] = words[1].strip() if len(words) > 1 else ""
    return out


@dataclass
class GravityModel:
    """A model's coefficients with its normal field, from its text and its coefficients' file."""

    k: Coefficients
    radius: float
    gm: float
    normal: NormalGravity
    correction: Coefficients | None = None
    offset: float = 0.0
    schmidt: bool = False

    @classmethod
    def read(cls, text: str, data: bytes, degree: int | None = None, order: int | None = None) -> GravityModel:
        """From the model's text and coefficients, those above a degree and an order left out."""
        m = key_values(text)
        stream = io.BytesIO(data)
        if stream.read(8).decode() != m["ID"][:8]:
            raise ValueError("the coefficients are of another model")
        k, more = (Coefficients.read(stream, degree, order) for _ in range(2))
        if k.c[0, 0] != 0:
            raise ValueError("the term of degree 0 must be 0")
        k.c[0, 0] = 1.0
        a, gm, omega = (float(m[x]) for x in ("ReferenceRadius", "ReferenceMass", "AngularVelocity"))
        if "DynamicalFormFactor" in m:
            normal = NormalGravity.from_j2(a, gm, omega, float(m["DynamicalFormFactor"]))
        else:
            f = m["Flattening"].split("/")
            normal = NormalGravity(Ellipsoid(a, float(f[0]) / (float(f[1]) if len(f) > 1 else 1.0)), gm, omega)
        times = float(m.get("CorrectionMultiplier", 1))
        more = Coefficients(more.c * times, more.s * times)
        return cls(k, float(m["ModelRadius"]), float(m["ModelMass"]), normal, more, float(m.get("HeightOffset", 0)), m.get("Normalization", "full").lower() == "schmidt")

    def _gravitation(self, x, y, z, circle=None) -> dict[str, np.ndarray]:
        g = harmonic_sum(self.k, self.radius, x, y, z, self.schmidt, circle)
        return {n: v * self.gm / self.radius for n, v in g.items()}

    def potentials(self, x, y, z, circle=None) -> dict[str, np.ndarray]:
        """v (gravitation), phi (centrifugal), w (both), t (disturbing)."""
        x, y, z = _columns(x, y, z)
        v = self._gravitation(x, y, z, circle)["v"]
        phi = self.normal.omega**2 * (x * x + y * y) / 2
        return {"v": v, "phi": phi, "w": v + phi, "t": v + phi - self.normal.at(x, y, z)["u"]}

    def _vector(self, lat, lon, h, disturbing: bool) -> dict[str, np.ndarray]:
        lat, lon, h = _columns(lat, lon, h)
        xyz, rows = _frame(lat, lon, h, self.normal.e)
        g = self._gravitation(*xyz, circles_of(lat, h))
        x, y, _ = xyz
        spin = self.normal.omega**2
        whole = [g["gx"] + spin * x, g["gy"] + spin * y, g["gz"]]
        out = {"w": g["v"] + spin * (x * x + y * y) / 2}
        if disturbing:
            n = self.normal.at(*xyz)
            whole = [a - n[c] for a, c in zip(whole, ("gx", "gy", "gz"))]
            out = {"t": out["w"] - n["u"]}
        return out | dict(zip(("east", "north", "up"), _turned(rows, whole)))

    def gravity(self, lat, lon, h) -> dict[str, np.ndarray]:
        """w, east, north, up."""
        return self._vector(lat, lon, h, False)

    def disturbance(self, lat, lon, h) -> dict[str, np.ndarray]:
        """t, east, north, up."""
        return self._vector(lat, lon, h, True)

    def geoid_height(self, lat, lon) -> np.ndarray:
        """Height of the geoid above the ellipsoid, by the disturbing potential there and the model's correction."""
        lat, lon = _columns(lat, lon)
        xyz, _ = _frame(lat, lon, 0.0 * lat, self.normal.e)
        circle = circles_of(lat)
        t = self.potentials(*xyz, circle)["t"]
        more = harmonic_sum(self.correction, np.hypot(np.hypot(xyz[0], xyz[1]), xyz[2]), *xyz, self.schmidt, circle)["v"] if self.correction is not None else 0.0
        return t / self.normal.surface(lat) + more + self.offset

    def anomaly(self, lat, lon, h) -> dict[str, np.ndarray]:
        """dg (gravity anomaly), xi, eta (deflections of the vertical, degrees), in spherical approximation."""
        lat, lon, h = _columns(lat, lon, h)
        xyz, _ = _frame(lat, lon, h, self.normal.e)
        d = self._vector(lat, lon, h, True)
        p, r = np.hypot(xyz[0], xyz[1]), np.sqrt(sum(c * c for c in xyz))
        n = self.normal.at(*xyz)
        size = np.sqrt(n["gx"] ** 2 + n["gy"] ** 2 + n["gz"] ** 2)
        s, c = sincosd(lat)
        sp, cp = xyz[2] / r, p / r  # of the geocentric latitude
        turn_s, turn_c = s * cp - c * sp, c * cp + s * sp
        up, north = d["up"] * turn_c + d["north"] * -turn_s, d["north"] * turn_c + d["up"] * turn_s
        return {"dg": -up - 2 * d["t"] / r, "xi": -np.degrees(north / size), "eta": -np.degrees(d["east"] / size)}


@dataclass
class MagneticModel:
    """A magnetic model: coefficients for epochs, the last of them yearly rates, and constant ones."""

    models: list[Coefficients]
    constants: list[Coefficients]
    radius: float
    epoch: float
    step: float
    e: Ellipsoid = WGS84
    valid: dict[str, float] = field(default_factory=dict)
    schmidt: bool = True

    @classmethod
    def read(cls, text: str, data: bytes, e: Ellipsoid = WGS84, degree: int | None = None, order: int | None = None) -> MagneticModel:
        """From the model's text and coefficients, those above a degree and an order left out."""
        m = key_values(text)
        stream = io.BytesIO(data)
        if stream.read(8).decode() != m["ID"][:8]:
            raise ValueError("the coefficients are of another model")
        n, c = int(m.get("NumModels", 1)), int(m.get("NumConstants", 0))
        blocks = [Coefficients.read(stream, degree, order) for _ in range(n + 1 + c)]
        valid = {k: float(m[k]) for k in ("MinTime", "MaxTime", "MinHeight", "MaxHeight") if k in m}
        return cls(blocks[: n + 1], blocks[n + 1 :], float(m["Radius"]), float(m["Epoch"]), float(m.get("DeltaEpoch", 1)), e, valid, m.get("Normalization", "schmidt").lower() != "full")

    def is_valid(self, t, h) -> np.ndarray:
        t, h = _columns(t, h)
        v = self.valid
        return (t >= v.get("MinTime", -np.inf)) & (t <= v.get("MaxTime", np.inf)) & (h >= v.get("MinHeight", -np.inf)) & (h <= v.get("MaxHeight", np.inf))

    def geocentric(self, t, x, y, z, circle=None) -> dict[str, np.ndarray]:
        """bx, by, bz (nT) and their yearly changes tx, ty, tz."""
        t, x, y, z = _columns(t, x, y, z)
        after = t - self.epoch
        n = np.clip(np.floor(after / self.step), 0, len(self.models) - 2).astype(int)
        out = {c: np.zeros_like(t) for c in ("bx", "by", "bz", "tx", "ty", "tz")}
        total = lambda k, on: [-self.radius * g for g in list(harmonic_sum(k, self.radius, x[on], y[on], z[on], self.schmidt, None if circle is None else circle[on]).values())[1:]]
        for i in np.unique(n):
            on = np.flatnonzero(n == i)
            one, two = total(self.models[i], on), total(self.models[i + 1], on)
            between = i + 1 < len(self.models) - 1
            gone = after[on] - i * self.step
            for c, a, b in zip("xyz", one, two):
                rate = (b - a) / self.step if between else b
                out[f"t{c}"][on] = rate
                out[f"b{c}"][on] = a + gone * rate
        for k in self.constants:
            for c, a in zip("xyz", total(k, np.arange(len(t)))):
                out[f"b{c}"] += a
        return out

    def field_at(self, t, lat, lon, h) -> dict[str, np.ndarray]:
        """east, north, up (nT), and their yearly changes east_t, north_t, up_t."""
        t, lat, lon, h = _columns(t, lat, lon, h)
        xyz, rows = _frame(lat, lon, h, self.e)
        g = self.geocentric(t, *xyz, circles_of(lat, h))
        b, c = _turned(rows, (g["bx"], g["by"], g["bz"])), _turned(rows, (g["tx"], g["ty"], g["tz"]))
        return dict(zip(("east", "north", "up", "east_t", "north_t", "up_t"), (*b, *c)))


def field_components(east, north, up) -> dict[str, np.ndarray]:
    """horizontal, total, declination (clockwise from north), inclination (downward), degrees."""
    h = np.hypot(east, north)
    return {"horizontal": h, "total": np.hypot(h, up), "declination": np.degrees(np.arctan2(east, north)), "inclination": np.degrees(np.arctan2(-up, h))}
