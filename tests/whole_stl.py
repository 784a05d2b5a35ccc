"""The decomposition of a series that is held whole, straight from its definition: what the blocks are compared with."""

from __future__ import annotations

import numpy as np


def loess(y: np.ndarray, window: int, degree: int = 1, at: np.ndarray | None = None) -> np.ndarray:
    """Local regression with tricube weights over the ``window`` nearest places, at places 0..n-1 or ``at`` (may lie outside)."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, float)
    q = min(window, n)
    left = np.clip(np.floor(at - (q - 1) / 2 + 0.5).astype(int), 0, n - q)
    idx = left[:, None] + np.arange(q)
    dx = idx - at[:, None]
    h = np.maximum(np.abs(dx).max(1), 1e-12) * (1 + 1e-9)
    if window > n:
        h = h + (window - n) / 2
    w = (1 - (np.abs(dx) / h[:, None]) ** 3) ** 3
    w /= w.sum(1, keepdims=True)
    v = y[idx]
    mean = (w * v).sum(1)
    if degree == 0:
        return mean
    mx = (w * dx).sum(1)
    var = (w * dx * dx).sum(1) - mx * mx
    slope = np.where(var > 1e-10, ((w * dx * v).sum(1) - mx * mean) / np.where(var > 1e-10, var, 1), 0)
    return mean - slope * mx


def moving_average(x: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], x]))
    return (c[k:] - c[:-k]) / k


def stl(y: np.ndarray, period: int, seasonal: int, trend: int | None = None, inner: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(seasonal, trend) of a series with n >= 2 periods."""
    n = len(y)
    trend = trend or int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) // 2 * 2 + 1
    low = period // 2 * 2 + 1
    t = np.zeros(n)
    for _ in range(inner):
        detrended, cycle = y - t, np.zeros(n + 2 * period)
        for phase in range(period):
            sub = detrended[phase::period]
            cycle[phase::period][: len(sub) + 2] = loess(sub, seasonal, 1, np.arange(-1, len(sub) + 1))
        smooth = moving_average(moving_average(moving_average(cycle, period), period), 3)
        s = cycle[period : period + n] - loess(smooth, low)[:n]
        t = loess(y - s, trend)
    return s, t


def mstl(y: np.ndarray, periods: tuple[int, ...], windows: tuple[int, ...] | None = None, iterations: int = 2) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Seasonal parts by period, trend and remainder; they add up to y. Periods of half the length or more are left out."""
    windows = windows or tuple(7 + 4 * (i + 1) for i in range(len(periods)))
    use = [(p, w) for p, w in sorted(zip(periods, windows, strict=True)) if p < len(y) / 2]
    seasons, rest, trend = {p: np.zeros(len(y)) for p, _ in use}, y.astype(float).copy(), np.zeros(len(y))
    for _ in range(iterations if len(use) > 1 else 1):
        for p, w in use:
            rest = rest + seasons[p]
            seasons[p], trend = stl(rest, p, w)
            rest = rest - seasons[p]
    if not use:
        trend = loess(rest, max(7, len(y) // 10 * 2 + 1)) if len(y) > 2 else rest.copy()
    return seasons, trend, rest - trend
