"""Series of sines and of whole periods, fitted to functions until their tails are small: on arrays, and their sums as native columns. Radians."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST, TAIL = 8, 4096, 1e-15


def sine_transform(samples: np.ndarray) -> np.ndarray:
    """Coefficients c of sum c_k sin((2 k + 1) s), k < n, from samples [..., n] at s = j pi / 2n, j = 1 .. n: the transform of the odd function of period 2 pi that is even about pi / 2."""
    n = samples.shape[-1]
    quarter = np.concatenate([np.zeros_like(samples[..., :1]), samples, samples[..., -2::-1]], axis=-1)
    half = np.concatenate([quarter, np.zeros_like(samples[..., :1])], axis=-1)[..., : 2 * n + 1]
    whole = np.concatenate([half[..., :-1], -half[..., ::-1][..., :-1]], axis=-1)
    c = -np.fft.fft(whole, axis=-1).imag[..., 1 : 2 * n : 2] / (2 * n)
    return c


def period_transform(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (a, b) of sum a_k cos(k s) + b_k sin(k s), k <= n, from 2n samples [..., 2n] at s = j pi / n, j = 0 .. 2n - 1."""
    n = samples.shape[-1] // 2
    c = np.fft.rfft(samples, axis=-1) / n
    c[..., 0] /= 2
    c[..., n] /= 2
    return c.real, -c.imag


def _refined(f: Callable, params, points: Callable, transform: Callable) -> list[np.ndarray]:
    """Coefficients of each row, from twice as many samples as long as the last quarter of them isn't small; NaN alone where a sample isn't finite."""
    params = [np.asarray(p, float) for p in np.broadcast_arrays(*(np.atleast_1d(p) for p in params))]
    out: list = [None] * len(params[0])
    left, n = np.arange(len(out)), LEAST
    while len(left):
        c = transform(np.broadcast_to(f(points(n)[None, :], *(p[left, None] for p in params)), (len(left), len(points(n)))))
        size = np.abs(c).max(axis=-1)
        bad = ~np.isfinite(c).all(axis=-1)
        done = bad | (np.abs(c[:, -(c.shape[1] // 4) :]).max(axis=-1) <= TAIL * size) | (2 * n > MOST)
        for row, k in zip(left[done], np.flatnonzero(done)):
            out[row] = np.array([np.nan]) if bad[k] else c[k]
        left, n = left[~done], 2 * n
    return out


def fit_sines(f: Callable, *params) -> list[np.ndarray]:
    """For each row of ``params`` the coefficients of ``sine_transform`` of f(s, *params), an odd function even about pi / 2; 4096 samples at most."""
    return _refined(f, params, lambda n: np.arange(1, n + 1) * (np.pi / 2 / n), sine_transform)


def fit_period(f: Callable, *params) -> list[np.ndarray]:
    """For each row of ``params`` the coefficients a_0, a_1, b_1, a_2, b_2, ... of f(s, *params), of period 2 pi."""

    def both(samples):
        a, b = period_transform(samples)
        return np.concatenate([a[:, :1], np.stack([a[:, 1:], b[:, 1:]], axis=-1).reshape(len(a), -1)], axis=1)

    return _refined(f, params, lambda n: np.arange(2 * n) * (np.pi / n), both)


def _sum(c: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.transform(c, term), F.lit(0.0), lambda a, x: a + x)


def sines(c: Column, s: Column) -> Column:
    """The series of ``fit_sines`` at s."""
    return _sum(c, lambda x, k: x * F.sin((2 * k + 1) * s))


def sines_integral(c: Column, s: Column) -> Column:
    """Its integral from 0 to s."""
    return _sum(c, lambda x, k: x * (1 - F.cos((2 * k + 1) * s)) / (2 * k + 1))


def period(c: Column, s: Column) -> Column:
    """The series of ``fit_period`` at s."""
    order = lambda k: F.floor((k + 1) / 2)
    return _sum(c, lambda x, k: x * F.when(k % 2 == 1, F.cos(order(k) * s)).otherwise(F.when(k == 0, F.lit(1.0)).otherwise(F.sin(order(k) * s))))


def period_integral(c: Column, s: Column) -> Column:
    """Its integral from 0 to s: a slope, and a series of the same period."""
    order = lambda k: F.floor((k + 1) / 2)
    return _sum(c, lambda x, k: F.when(k == 0, x * s).otherwise(x * F.when(k % 2 == 1, F.sin(order(k) * s)).otherwise(1 - F.cos(order(k) * s)) / F.greatest(order(k), F.lit(1))))


def inverse_integral(c: list[np.ndarray], y) -> np.ndarray:
    """s at which the integral of each row's positive function of period 2 pi is y: Newton's method, kept inside the period's bracket. NaN where c holds NaN or y isn't finite."""
    y = np.array(y, float)
    table = np.zeros((len(c), max([len(x) for x in c] + [3]) | 1))
    for row, x in zip(table, c):
        row[: len(x)] = x
    mean, a, b = table[:, 0], table[:, 1::2], table[:, 2::2]
    k = np.arange(1, a.shape[1] + 1)
    good = np.isfinite(y) & np.isfinite(table).all(axis=1) & (mean > 0)
    turns = np.floor(np.where(good, y / np.where(good, mean, 1), 0) / (2 * np.pi))
    rest = y - turns * 2 * np.pi * mean
    out = np.where(good, rest / np.where(good, mean, 1), np.nan)
    low, high, left = np.zeros_like(y), np.full_like(y, 2 * np.pi), np.flatnonzero(good)
    for _ in range(60):
        s = out[left]
        sin, cos = np.sin(k * s[:, None]), np.cos(k * s[:, None])
        miss = mean[left] * s + (a[left] / k * sin).sum(axis=1) + (b[left] / k * (1 - cos)).sum(axis=1) - rest[left]
        low[left], high[left] = np.where(miss < 0, s, low[left]), np.where(miss < 0, high[left], s)
        new = s - miss / (mean[left] + (a[left] * cos).sum(axis=1) + (b[left] * sin).sum(axis=1))
        new = np.where((new >= low[left]) & (new <= high[left]), new, (low[left] + high[left]) / 2)
        out[left] = new
        left = left[np.abs(new - s) > 1e-15 * np.maximum(1, np.abs(new))]
        if not len(left):
            break
    return out + turns * 2 * np.pi
