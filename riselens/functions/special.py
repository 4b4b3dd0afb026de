"""Special functions on numpy arrays, for report-sized results."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction.

    The fraction converges fast left of the mean (a + 1) / (a + b + 2); right of
    it the complement is taken at 1 - x.
    """
    a, b, x = (np.asarray(v, dtype=np.float64) for v in np.broadcast_arrays(a, b, x))
    far = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(far, b, a), np.where(far, a, b), np.where(far, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    front = np.where((z <= 0) | (z >= 1), 0.0, front)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 20_000):
        before = h.copy()
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(h - before) <= 1e-15 * np.abs(h)):
            break
    part = np.where(z >= 1, 1.0, front * h)
    return np.where(far, 1 - part, part)


def student_t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom; NaN without t or without freedom."""
    t, df = (np.asarray(v, dtype=np.float64) for v in np.broadcast_arrays(t, df))
    known = ~np.isnan(t) & (df > 0)
    v, u = np.where(known, df, 1.0), np.where(known, t, 0.0)
    # v / (v + t^2) is close to 1 for large v: its complement is exact
    share = u * u / (v + u * u)
    p = np.where(share < 0.5, 1 - incomplete_beta(np.full_like(v, 0.5), v / 2, share), incomplete_beta(v / 2, np.full_like(v, 0.5), v / (v + u * u)))
    return np.where(known, np.clip(p, 0, 1), np.nan)
