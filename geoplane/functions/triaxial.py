"""Triaxial ellipsoids with half axes a >= b >= c: coordinates and points on the surface, on arrays. Degrees and metres."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .geodesic import _columns, sincosd


@dataclass(frozen=True)
class Triaxial:
    a: float = 6378172.0
    b: float = 6378102.0
    c: float = 6356752.0

    @property
    def axes2(self) -> np.ndarray:
        return np.array([self.a, self.b, self.c]) ** 2

    def _from_normal(self, n: np.ndarray, h) -> np.ndarray:
        """Points at the height h above where the outward direction is n [3, rows]."""
        foot = self.axes2[:, None] * n / np.sqrt((self.axes2[:, None] * n * n).sum(axis=0))
        return foot + h * n

    def geodetic(self, lat, lon, h=0.0) -> dict[str, np.ndarray]:
        """x, y, z of a latitude and longitude of the surface's normal, and a height along it."""
        lat, lon, h = _columns(lat, lon, h)
        (sp, cp), (sl, cl) = sincosd(lat), sincosd(lon)
        return dict(zip("xyz", self._from_normal(np.stack([cp * cl, cp * sl, sp]), h)))

    def parametric(self, lat, lon) -> dict[str, np.ndarray]:
        lat, lon = _columns(lat, lon)
        (sp, cp), (sl, cl) = sincosd(lat), sincosd(lon)
        return {"x": self.a * cp * cl, "y": self.b * cp * sl, "z": self.c * sp}

    def geocentric(self, lat, lon) -> dict[str, np.ndarray]:
        """The surface's point in the direction of a geocentric latitude and longitude."""
        lat, lon = _columns(lat, lon)
        (sp, cp), (sl, cl) = sincosd(lat), sincosd(lon)
        n = np.stack([cp * cl, cp * sl, sp])
        return dict(zip("xyz", n / np.sqrt((n * n / self.axes2[:, None]).sum(axis=0))))

    def foot(self, x, y, z) -> tuple[np.ndarray, np.ndarray]:
        """The nearest point of the surface [3, rows], and the height above it: the largest root of the secular equation, by Newton's method from above."""
        p = np.stack(_columns(x, y, z))
        k = self.axes2[:, None]
        # the root is no more than where each term alone gives 1
        p_scaled = np.abs(p) * np.sqrt(k)
        t = np.maximum(p_scaled[2] - k[2], np.maximum(np.hypot(p_scaled[1], p_scaled[2]) - k[1], np.sqrt((p_scaled**2).sum(axis=0)) - k[0]))
        t = np.maximum(t, -k[2] * (1 - 1e-15))
        for _ in range(100):
            q = p_scaled / (t + k)
            f, slope = (q * q).sum(axis=0) - 1, -2 * (q * q / (t + k)).sum(axis=0)
            step = np.where(slope < 0, -f / np.where(slope < 0, slope, 1), 0.0)
            if not (np.abs(step) > 1e-15 * np.abs(t + k[0])).any():
                break
            t = np.maximum(t + step, -k[2] * (1 - 1e-15))
        r = k * p / (t + k)
        size = np.sqrt((r * r / k).sum(axis=0))
        r = r / np.where(size > 0, size, 1)
        h = t * np.sqrt((r * r / k**2).sum(axis=0))
        return r, h

    def geodetic_reverse(self, x, y, z) -> dict[str, np.ndarray]:
        """lat, lon, h."""
        r, h = self.foot(x, y, z)
        n = r / self.axes2[:, None]
        return {"lat": np.degrees(np.arctan2(n[2], np.hypot(n[0], n[1]))), "lon": np.degrees(np.arctan2(n[1], n[0])), "h": h}

    def parametric_reverse(self, x, y, z) -> dict[str, np.ndarray]:
        r, h = self.foot(x, y, z)
        n = r / np.sqrt(self.axes2[:, None])
        return {"lat": np.degrees(np.arctan2(n[2], np.hypot(n[0], n[1]))), "lon": np.degrees(np.arctan2(n[1], n[0])), "h": h}

    def geocentric_reverse(self, x, y, z) -> dict[str, np.ndarray]:
        r, h = self.foot(x, y, z)
        return {"lat": np.degrees(np.arctan2(r[2], np.hypot(r[0], r[1]))), "lon": np.degrees(np.arctan2(r[1], r[0])), "h": h}

    @property
    def _k(self) -> tuple[float, float]:
        """k2 and kp2, which add up to 1: how the axes share their differences."""
        a2, b2, c2 = self.axes2.tolist()
        return (b2 - c2) / (a2 - c2), (a2 - b2) / (a2 - c2)

    def ellipsoidal(self, bet, omg) -> dict[str, np.ndarray]:
        """x, y, z on the surface of ellipsoidal latitude and longitude, whose lines are those of curvature."""
        bet, omg = _columns(bet, omg)
        (sb, cb), (so, co) = sincosd(bet), sincosd(omg)
        k2, kp2 = self._k
        return {"x": self.a * co * np.sqrt(k2 * cb**2 + kp2), "y": self.b * cb * so, "z": self.c * sb * np.sqrt(k2 + kp2 * so**2)}

    def ellipsoidal_reverse(self, x, y, z) -> dict[str, np.ndarray]:
        """bet, omg, h: of the nearest point of the surface, by the roots of a quadratic."""
        r, h = self.foot(x, y, z)
        return self._lines(r / np.sqrt(self.axes2[:, None])) | {"h": h}

    def _lines(self, u: np.ndarray) -> dict[str, np.ndarray]:
        """bet, omg of a point of the surface, its coordinates over the axes."""
        return self._lines_of(u, *self._k)

    @staticmethod
    def _lines_of(u: np.ndarray, k2: float, kp2: float) -> dict[str, np.ndarray]:
        # with A = cos(bet)^2 and B = sin(omg)^2, y^2 = A B and z^2 = (1 - A) (k2 + kp2 B): so k2 A^2 - m A - kp2 y^2 = 0
        m = k2 - kp2 * u[1] ** 2 - u[2] ** 2
        root = np.sqrt(np.maximum(m * m + 4 * k2 * kp2 * u[1] ** 2, 0))
        cb2 = np.clip(np.where(m > 0, (m + root) / (2 * k2) if k2 else 1.0, 2 * kp2 * u[1] ** 2 / np.where(root - m > 0, root - m, 1)), 0, 1)
        so2 = np.clip(np.where(cb2 > 0, u[1] ** 2 / np.where(cb2 > 0, cb2, 1), (u[2] ** 2 - k2) / kp2 if kp2 else 0.0), 0, 1)
        sb, so = np.copysign(np.sqrt(1 - cb2), u[2]), np.copysign(np.sqrt(so2), u[1])
        return {"bet": np.degrees(np.arctan2(sb, np.sqrt(cb2))), "omg": np.degrees(np.arctan2(so, np.copysign(np.sqrt(1 - so2), u[0])))}

    def confocal(self, bet, omg, h) -> dict[str, np.ndarray]:
        """x, y, z of ellipsoidal coordinates on the confocal ellipsoid whose least half axis is h longer."""
        bet, omg, h = _columns(bet, omg, h)
        unit = self.ellipsoidal(bet, omg)
        a2, b2, c2 = self.axes2
        u2 = (self.c + h) ** 2
        return {"x": unit["x"] / self.a * np.sqrt(u2 + a2 - c2), "y": unit["y"] / self.b * np.sqrt(u2 + b2 - c2), "z": unit["z"] / self.c * np.sqrt(u2)}

    def confocal_reverse(self, x, y, z) -> dict[str, np.ndarray]:
        """bet, omg, h of any point outside the focal ellipse, by the largest root of x^2 / (q + a^2 - c^2) + y^2 / (q + b^2 - c^2) + z^2 / q = 1."""
        p2 = np.stack(_columns(x, y, z)) ** 2
        more = (self.axes2 - self.axes2[2])[:, None]
        q = np.maximum(p2.sum(axis=0), 1e-300)
        for _ in range(200):  # from above: the sum is convex and falls
            t = p2 / (q + more)
            f, slope = t.sum(axis=0) - 1, -(t / (q + more)).sum(axis=0)
            step = np.where(slope < 0, -f / np.where(slope < 0, slope, 1), 0.0)
            low = np.maximum(p2[2], q * 1e-6)
            q = np.maximum(q + step, low)
            if not (np.abs(step) > 1e-15 * q).any():
                break
        u = np.stack(_columns(x, y, z)) / np.sqrt(q + more)
        return self._lines(u) | {"h": np.sqrt(q) - self.c}

    def random_points(self, n: int, seed: int | list[int] = 0) -> dict[str, np.ndarray]:
        """Points spread evenly over the surface: directions of the sphere, kept in proportion to how much area they are stretched to."""
        rng = np.random.default_rng(seed)
        kept = np.zeros((3, 0))
        most = 1 / self.c
        while kept.shape[1] < n:
            u = rng.standard_normal((3, 2 * n))
            u /= np.sqrt((u * u).sum(axis=0))
            stretch = np.sqrt((u * u / self.axes2[:, None]).sum(axis=0))
            kept = np.concatenate([kept, (np.sqrt(self.axes2[:, None]) * u)[:, rng.random(2 * n) * most < stretch]], axis=1)
        return dict(zip("xyz", kept[:, :n]))
