"""Ellipsoids of revolution."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Ellipsoid:
    """Equatorial radius in metres and flattening."""

    a: float = 6378137.0
    f: float = 1 / 298.257223563

    @property
    def b(self) -> float:
        return self.a * (1 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    @property
    def authalic2(self) -> float:
        """Square of the radius of the sphere of equal area."""
        e = math.sqrt(abs(self.e2))
        if e == 0:
            return self.a**2
        bulge = math.atanh(e) if self.f > 0 else math.atan(e)
        return (self.a**2 + self.b**2 * bulge / e) / 2

    @property
    def area(self) -> float:
        return 4 * math.pi * self.authalic2


WGS84 = Ellipsoid()


def authalic_sphere(e: Ellipsoid) -> Ellipsoid:
    """The sphere of the same area."""
    return Ellipsoid(math.sqrt(e.authalic2), 0.0)
