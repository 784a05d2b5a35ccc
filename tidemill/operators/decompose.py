"""Seasonal-trend decomposition by LOESS, for one or several periods, of series of any length.

STL after Cleveland et al. 1990 (inner loop, no robustness weights); several periods after
Bandara et al. 2021: seasons are refined in turn, twice. Defaults that public
descriptions leave open are parameters.

All steps of STL are weighted sums over a bounded reach of positions. So a series is cut into blocks of positions, and a block also gets the rows within
that reach on both sides (a halo); its own rows come out as they would from the whole series. Each season in turn is one round over
all blocks of all series, written as a table. A task holds one block and its halos, whatever the length of the series.
"""

from __future__ import annotations

import uuid
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .ordered import BLOCK

INNER = 5


def weighted_sums(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of w times each stretch of len(w) values; by Fourier transforms where w is long."""
    if len(w) <= 512:
        return np.convolve(y, w[::-1], "valid")
    size = 1 << (len(y) + len(w)).bit_length()
    return np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(w[::-1], size), size)[len(w) - 1 : len(y)]


def tricube(dx: np.ndarray, window: int, n: int) -> np.ndarray:
    """The weights of places at distances ``dx`` (last axis) in a local line through them, as seen from 0."""
    h = np.maximum(np.abs(dx).max(-1, keepdims=True), 1e-12) * (1 + 1e-9) + max(window - n, 0) / 2
    w = (1 - (np.abs(dx) / h) ** 3) ** 3
    w /= w.sum(-1, keepdims=True)
    mx = (w * dx).sum(-1, keepdims=True)
    var = (w * dx * dx).sum(-1, keepdims=True) - mx * mx
    return w - np.where(var > 1e-10, mx / np.where(var > 1e-10, var, 1), 0) * w * (dx - mx)


def loess(y: np.ndarray, lo: int, n: int, window: int, start: int, stop: int) -> np.ndarray:
    """Local lines with tricube weights over the ``window`` nearest places, at places ``start`` to ``stop`` - 1 of a series of n, whose values from place ``lo`` on are y.

    Places outside the series are extrapolated. y must hold what the windows cover.
    """
    q = min(window, n)
    at = np.arange(start, stop)
    free = at - (q - 1) // 2
    left = np.clip(free, 0, n - q)
    out, inside = np.empty(len(at)), np.flatnonzero(left == free)
    if len(inside):
        first, last = inside[0], inside[-1]
        span = y[left[first] - lo : left[last] + q - lo]
        out[first : last + 1] = weighted_sums(span, tricube(np.arange(q) - (q - 1.0) // 2, window, n))
    edge, many = np.flatnonzero(left != free), max(1, (1 << 21) // q)
    for i in range(0, len(edge), many):  # bounded memory
        e = edge[i : i + many]
        idx = left[e, None] + np.arange(q)
        out[e] = (tricube((idx - at[e, None]).astype(float), window, n) * y[idx - lo]).sum(1)
    return out


def moving_average(x: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], x]))
    return (c[k:] - c[:-k]) / k


def spans(period: int, seasonal: int) -> tuple[int, int]:
    """The windows of the trend and of the low pass."""
    return ceil(1.5 * period / (1 - 1.5 / seasonal)) // 2 * 2 + 1, period // 2 * 2 + 1


def reach(period: int, seasonal: int) -> int:
    """How many positions to each side a result depends on, at most."""
    return INNER * (period * (seasonal + 2) + sum(spans(period, seasonal)))


def stl(y: np.ndarray, lo: int, n: int, period: int, seasonal: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(seasonal, trend, a, b) of a series of n >= 2 periods, at places a to b - 1, from its values y at places from ``lo`` on.

    At the ends of the series all places come out; where the stretch is cut, those within ``reach`` of the cut don't.
    """
    trend, low = spans(period, seasonal)

    def inner(a: int, b: int, by: int) -> tuple[int, int]:
        return 0 if a <= 0 else a + by, n if b >= n else b - by

    a, b, t = lo, lo + len(y), np.zeros(len(y))
    for _ in range(INNER):
        detrended = y[a - lo : b - lo] - t
        ca, cb = inner(a, b, period * (seasonal + 1))
        ca, cb = -period if a == 0 else ca, n + period if b == n else cb
        cycle = np.empty(cb - ca)
        for phase in range(period):
            first, start, stop = (-((phase - x) // period) for x in (a, ca, cb))
            m = -((phase - n) // period)
            cycle[phase + period * start - ca :: period] = loess(detrended[phase + period * first - a :: period], first, m, seasonal, start, stop)
        smooth = moving_average(moving_average(moving_average(cycle, period), period), 3)
        sa, sb = ca + period, cb - period
        la, lb = inner(sa, sb, low)
        s = cycle[la - ca : lb - ca] - loess(smooth, sa, n, low, la, lb)
        a, b = inner(la, lb, trend)
        t = loess(y[la - lo : lb - lo] - s, la, n, trend, a, b)
    return s[a - la : b - la], t, a, b


def decompose(series: DataFrame, value: str = "y", periods: tuple[int, ...] = (24, 168, 8760), block: int = BLOCK) -> DataFrame:
    """Adds trend, one column ``s<period>`` per period and resid; the parts add up to the value.

    ``idx`` counts from 0 without gaps in each series (``series_id``, or the whole table). A period of half the length or more is left out (0); a series without a period is smoothed
    by one LOESS. A null makes the parts within its reach null or NaN. An empty table gives no rows.
    """
    if not periods:
        raise ValueError("no period")
    key, s = "series_id", Scratch(series.sparkSession)
    keyed = series if key in series.columns else series.selectExpr("0 series_id", "*")
    use = sorted(zip(periods, (7 + 4 * (i + 1) for i in range(len(periods))), strict=True))
    seasons = [f"_s{p}" for p, _ in use]
    own = keyed.select(F.col(key).alias("_key"), F.col("idx").cast("long").alias("_at"), F.col(value).cast("double").alias("_rest"))
    sizes = own.groupBy("_key").agg(F.count("*").alias("_n"))
    state = s.save(own.join(sizes.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k"))).drop("_k").withColumns({c: F.lit(0.0) for c in [*seasons, "_trend"]}))

    def turn(again: bool, period: int, seasonal: int, size: int):
        season = f"_s{period}"

        def part(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_at", ignore_index=True)
            n, lo, start = int(pdf["_n"][0]), int(pdf["_at"][0]), int(pdf["_block"][0]) * size
            mine = slice(start - lo, min(start + size, n) - lo)
            out = pdf.iloc[mine].drop(columns="_block")
            if n <= 2 * period or again and n <= 2 * use[1][0]:
                if not again and period == use[0][0]:  # no period fits; the series is one short block
                    whole = pdf["_rest"].to_numpy(float)
                    out["_trend"] = loess(whole, 0, n, max(7, n // 10 * 2 + 1), 0, n) if n > 2 else whole
                return out
            y = (pdf["_rest"] + pdf[season]).to_numpy(float)
            found, trend, a, _ = stl(y, lo, n, period, seasonal)
            own = slice(start - a, start - a + len(out))
            return out.assign(_rest=y[mine] - found[own], _trend=trend[own], **{season: found[own]})

        return part

    for again in range(2 if len(use) > 1 else 1):
        for period, seasonal in use:
            far = reach(period, seasonal)
            size = max(block, far)
            at, last = F.col("_at"), F.col("_n") - 1
            blocks = F.sequence(F.floor(F.greatest(at - far, F.lit(0)) / size), F.floor(F.least(at + far, last) / size))
            sent = state.withColumn("_block", F.explode(blocks))
            after = s.save(sent.groupBy("_key", "_block").applyInPandas(turn(bool(again), period, seasonal, size), state.schema))
            s.drop(state)
            state = after
    tag = uuid.uuid4().hex  # columns of users may have any name
    made = {"trend": F.col("_trend"), **{f"s{p}": F.col(f"_s{p}") for p in periods}, "resid": F.col("_rest") - F.col("_trend")}
    parts = state.select(F.col("_key").alias(f"key_{tag}"), F.col("_at").alias(f"at_{tag}"), *[c.alias(f"{name}_{tag}") for name, c in made.items()])
    out = keyed.join(parts, F.col(key).eqNullSafe(F.col(f"key_{tag}")) & (F.col("idx") == F.col(f"at_{tag}")))
    return out.select(*[f"`{c}`" for c in series.columns if c not in made], *[F.col(f"{name}_{tag}").alias(name) for name in made])
