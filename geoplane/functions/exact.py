"""Angles with exact quadrants and signed zeros, and sums that keep what doubles leave out, on arrays."""

from __future__ import annotations

import math

import numpy as np

from .geodesic import difference, normalized, sincosd, two_sum

OVERFLOW = 2.0**104


def ang_round(x) -> np.ndarray:
    """Near 0, x rounded to the spacing of numbers near 1/16; so tiny angles are 0 and 1/16 degree less itself is exact."""
    x = np.asarray(x, np.float64)
    z, y = 1 / 16, np.abs(x)
    return np.copysign(np.where(y < z, z - (z - y), y), x)


def tand(x) -> np.ndarray:
    """Tangent of degrees; 2 ** 104 with a sign where it is infinite."""
    s, c = sincosd(x)
    return np.where(c == 0, np.copysign(OVERFLOW, s), s / np.where(c == 0, 1, c))


def atan2d(y, x) -> np.ndarray:
    """Degrees of the direction (x, y), exact at multiples of 45, in [-180, 180]."""
    y, x = np.broadcast_arrays(np.asarray(y, np.float64), np.asarray(x, np.float64))
    steep = np.abs(y) > np.abs(x)
    a, b = np.where(steep, x, y), np.where(steep, y, x)
    back = np.signbit(b)
    angle = np.degrees(np.arctan2(a, np.abs(b)))
    return np.where(steep, np.where(back, -90 + angle, 90 - angle), np.where(back, np.copysign(180.0, a) - angle, angle))


def atand(x) -> np.ndarray:
    return atan2d(x, np.ones_like(np.asarray(x, np.float64)))


def exact_trig(x) -> dict[str, np.ndarray]:
    """sin, cos, tan of degrees, and the angle itself in [-180, 180]."""
    s, c = sincosd(x)
    return {"sin": s, "cos": c, "tan": tand(x), "norm": normalized(x)}


def polynomial(coefficients, x) -> np.ndarray:
    """By Horner's rule, from the highest power on; 0 without coefficients."""
    y = np.zeros_like(np.asarray(x, np.float64))
    for c in coefficients:
        y = y * x + c
    return y


class Accumulator:
    """A sum in two doubles; about 32 digits."""

    def __init__(self, s: float = 0.0, t: float = 0.0):
        self.s, self.t = float(s), float(t)

    def add(self, y: float) -> Accumulator:
        y, u = (float(v) for v in two_sum(np.float64(y), np.float64(self.t)))
        self.s, self.t = (float(v) for v in two_sum(np.float64(y), np.float64(self.s)))
        if self.s == 0:
            self.s = u
        else:
            self.t += u
        return self

    def value(self, more: float = 0.0) -> float:
        a = Accumulator(self.s, self.t).add(more)
        return a.s + a.t

    def scaled(self, n: int) -> Accumulator:
        """Times a whole number."""
        high, low = self.s * n, math.fma(self.s, n, -self.s * n) if hasattr(math, "fma") else 0.0
        return Accumulator(high, low + self.t * n).add(0.0)

    def remainder(self, y: float) -> Accumulator:
        """What is left of dividing by y, nearest to 0."""
        self.s = math.remainder(self.s, y)
        return self.add(0.0)


__all__ = ["Accumulator", "ang_round", "atan2d", "atand", "difference", "exact_trig", "normalized", "polynomial", "sincosd", "tand", "two_sum"]
