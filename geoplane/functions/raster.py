"""Heights between the cells of a grid over the globe: bilinear, or by cubics fitted to twelve cells."""

from __future__ import annotations

from functools import cache

import numpy as np

#: The twelve cells around (row, column), the corners of the sixteen left out; the inner four weigh twice.
CELLS = [(r, c) for r in (-1, 0, 1, 2) for c in (-1, 0, 1, 2) if not (r in (-1, 2) and c in (-1, 2))]
#: Powers of x and y of a cubic.
TERMS = [(i, j) for i in range(4) for j in range(4 - i)]
#: Which cubic: one beside no pole, one that is the same at all longitudes of the cell at the north pole (y = 0), or at the south pole (y = 1).
INNER, NORTH, SOUTH = 0, 1, 2


@cache
def cubic(kind: int) -> np.ndarray:
    """[term, cell]: a fitted cubic's coefficients as sums over the cells, by weighted least squares. For SOUTH powers are of 1 - y."""
    terms = TERMS if kind == INNER else [(i, j) for i, j in TERMS if not (i and not j)]
    weight = np.array([np.sqrt(2.0) if r in (0, 1) and c in (0, 1) else 1.0 for r, c in CELLS])
    design = np.array([[float(c) ** i * float(1 - r if kind == SOUTH else r) ** j for i, j in terms] for r, c in CELLS])
    out = np.zeros((len(TERMS), len(CELLS)))
    out[[TERMS.index(t) for t in terms]] = np.linalg.pinv(design * weight[:, None]) * weight
    return out


def between(cells: np.ndarray, x: np.ndarray, y: np.ndarray, kind: np.ndarray, smooth: bool = True) -> np.ndarray:
    """Heights at x, y in a cell (0 to 1, eastward and southward) from the values [cell, point] of CELLS around it."""
    if not smooth:
        a, b, c, d = (cells[CELLS.index(k)] for k in ((0, 0), (0, 1), (1, 0), (1, 1)))
        return (1 - y) * ((1 - x) * a + x * b) + y * ((1 - x) * c + x * d)
    out = np.full(x.shape, np.nan)
    for k in (INNER, NORTH, SOUTH):
        on = kind == k
        if on.any():
            v = 1 - y[on] if k == SOUTH else y[on]
            out[on] = sum(f * x[on] ** i * v**j for f, (i, j) in zip(cubic(k) @ cells[:, on], TERMS))
    return out
