"""Leading eigenpairs of the normalised kernel over all rows, by Chebyshev-filtered subspace iteration (Zhou, Saad, Tiago, Chelikowsky 2006).

The kernel is never stored: each product with a panel of a bounded number of columns goes tile by tile, and the
panel is a written table. Between products a polynomial of the matrix, small on the unwanted
part of the spectrum, turns the panel towards the wanted eigenvectors; Rayleigh-Ritz problems of the panel's
width, the sums of its products by blocks, are all that the driver solves. It ends when every wanted pair has a residual below ``tol``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import Tiles, added, multiply

#: Greatest growth of one wanted direction over another in one run of the filter: times the rounding error, it is what a column loses.
GROWTH = 1e6
#: Steps of the first filter, at most.
FIRST = 3
#: Dimensions that widen the panel, at most.
MOST_DIMS = 128
BASE = "g int, b int, k array<bigint>, x array<double>, deg array<double>"
STATE = BASE + ", top array<double>, y0 array<double>, y1 array<double>"


def _sums(df: DataFrame, f, width: int) -> np.ndarray:
    """The sum over blocks of the ``width`` numbers that ``f(row)`` gives, added in the tasks and then by place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for batch in batches:
            for row in batch.itertuples(index=False):
                total += f(row)
        yield pd.DataFrame({"at": np.arange(width), "v": total})

    out = np.zeros(width)
    for r in df.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _rotated(t: Tiles, turn: np.ndarray, values: np.ndarray, filtered: tuple[float, float, float]) -> tuple[Tiles, np.ndarray]:
    """Panels times ``turn``, the residuals of the pairs, and by (c, e, s) in y1 the first step of the filter."""
    schema = STATE + ", res array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {c: [] for c in ("y0", "y1", "res")}
            for row in batch.itertuples(index=False):
                q, w = (np.reshape(v, (len(row.k), -1)) @ turn for v in (row.y0, row.y1))
                out["res"].append(((w - q * values) ** 2).sum(0))
                w = (w - filtered[0] * q) * (filtered[2] / filtered[1])
                out["y0"].append(q.ravel())
                out["y1"].append(w.ravel())
            yield batch.assign(**out)[["g", "b", "k", "x", "deg", "top", "y0", "y1", "res"]]

    new = t.with_rows(t.rows.mapInPandas(run, schema), t.rows)
    return new, np.sqrt(_sums(new.rows.select("res"), lambda row: row.res, len(values)))


def _top(t: Tiles, eps: float, method: str, most: int = 12) -> tuple[Tiles, float]:
    """The first eigenvector, as ``top``, and its eigenvalue, by powers from the roots of the degrees, which are close to it; for ``markov`` they are that vector itself, of eigenvalue 1.

    Where the second eigenvalue is so near that powers take more than ``most`` rounds, the eigenvalue is given as 0: there the filter does without.
    """
    schema, last = BASE + ", top array<double>, y array<double>", np.inf
    t = t.with_rows(t.rows.withColumn("top", F.transform("deg", F.sqrt)), t.rows)
    if method == "markov":
        norm = float(np.sqrt(_sums(t.rows.select("deg"), lambda row: np.array([row.deg.sum()]), 1)[0]))
        return t.with_rows(t.rows.withColumn("top", F.transform("top", lambda v: v / norm)), t.rows), 1.0
    for _ in range(most):
        t = t.with_rows(added(t, multiply(t, eps, method, "top"), lambda row, y: {"y": y}, schema), t.rows)
        qq, qy, yy = _sums(t.rows.select("top", "y"), lambda row: np.array([row.top @ row.top, row.top @ row.y, row.y @ row.y]), 3)
        value = qy / qq
        res = np.sqrt(_sums(t.rows.select("top", "y"), lambda row, value=value: np.array([((row.y - value * row.top) ** 2).sum()]), 1)[0] / qq)
        if res <= 1e-14 * value or res <= 1e-11 * value and res >= last / 2:
            return t.with_rows(t.rows.withColumn("top", F.transform("top", lambda v: v / float(np.sqrt(qq)))).drop("y"), t.rows), value
        last = res
        t = t.with_rows(t.rows.withColumn("top", F.transform("y", lambda v: v / float(np.sqrt(yy)))).drop("y"), t.rows)
    return t, 0.0


def leading(t: Tiles, eps: float, count: int = 20, method: str = "markov", tol: float = 1e-9, degree: int = 12, most: int = 60, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """The ``count`` greatest eigenvalues after the first, falling, and a table (k, v): per row its entries of the unit eigenvectors.

    The first pair is taken off the matrix, as the filter would let it outgrow all others. Fewer pairs where there are fewer rows, or where the rest of the
    spectrum is 0. Signs are such that the sum of cubes is not negative.
    """
    if t.n < 2:
        return np.zeros(0), t.rows.select(F.explode("k").alias("k"), F.array().cast("array<double>").alias("v"))
    t = t.with_rows(added(t, multiply(t, eps, "degree", None), lambda row, y: {"deg": y}, BASE))
    t, top = _top(t, eps, method)
    skip = int(top == 0)
    # rows that spread evenly have an eigenvalue of about one size for each dimension: a panel that ends among them hardly tells them apart
    dims = t.rows.select((F.size("x") / F.size("k")).cast("int").alias("n")).first()["n"]
    m, want = min(t.n, max(2 * count + 24, count + min(dims, MOST_DIMS) + 12)), min(count, t.n - 1) + skip

    def start(row) -> np.ndarray:
        return np.random.default_rng([seed, int(row.b)]).standard_normal(len(row.k) * m)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(y0=[np.zeros(0)] * len(batch), y1=[start(row) for row in batch.itertuples(index=False)])

    t = t.with_rows(t.rows.mapInPandas(begin, STATE), t.rows)
    low = 0.0
    for round_ in range(most):
        # y0 becomes the panel, y1 the matrix times it
        t = t.with_rows(added(t, multiply(t, eps, method, "y1", top), lambda row, y: {"y0": row["y1"], "y1": y}, STATE), t.rows)

        def products(row) -> np.ndarray:
            q, w = (np.reshape(v, (len(row.k), -1)) for v in (row.y0, row.y1))
            return np.concatenate([(q.T @ q).ravel(), (q.T @ w).ravel()])

        width = m * m
        both = _sums(t.rows.select("k", "y0", "y1"), products, 2 * width)
        gram, inner = both[:width].reshape(m, m), both[width:].reshape(m, m)
        scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
        g, u = np.linalg.eigh(gram * scale[:, None] * scale)
        kept = g > 1e-12 * g[-1]
        white = scale[:, None] * (u[:, kept] / np.sqrt(g[kept]))
        h = white.T @ inner @ white
        values, v = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], (white @ v[:, ::-1])
        m, want = len(values), min(want, len(values))
        low = min(low, values[-1]) if method == "markov" else min(low, -values[min(m, want) - 1] / 8, 1.05 * values[-1])
        c, e = (low + values[-1]) / 2, (values[-1] - low) / 2
        steps, damped = 1, e > 1e-12
        if damped:
            # so many steps that the first of the wanted pairs outgrows the last by GROWTH at most
            rate = np.arccosh(max(1.0, (values[want - 1] - c) / e))
            apart = np.arccosh((values[0] - c) / e) - rate
            steps = int(np.clip(np.log(GROWTH) / max(apart, 1e-9), 1, degree))
        else:
            c, e = 0.0, float(max(values[0], 1e-300))  # nothing is left to damp: a power of the matrix
        s1 = e / (values[0] - c)
        t, res = _rotated(t, turn, values, (c, e, s1))
        if m == t.n or (res[:want] <= tol).all():
            break
        # and no more than the residuals need; the values of a random panel do not tell that yet
        if not round_:
            steps = min(steps, FIRST)
        elif damped:
            steps = int(min(steps, max(1, np.ceil(np.log(20 * max(res[:want].max() / tol, 1.0)) / max(rate, 1e-9)))))
        s = s1
        for _ in range(2, steps + 1):
            s2 = 1 / (2 / s1 - s)

            def step(row, y, s=s, s2=s2) -> dict:
                y0, y1 = np.asarray(row["y0"]), np.asarray(row["y1"])
                return {"y0": y1, "y1": (y - c * y1) * (2 * s2 / e) - s * s2 * y0}

            t = t.with_rows(added(t, multiply(t, eps, method, "y1", top), step, STATE), t.rows)
            s = s2
    else:
        raise RuntimeError(f"eigenpairs have residuals of {res[:want].max():.1e} after {most} rounds")
    cubes = _sums(t.rows.select("k", "y0"), lambda row: (np.reshape(row.y0, (len(row.k), -1)) ** 3).sum(0), m)
    sign = np.where(cubes < 0, -1.0, 1.0)[skip:want]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                q = np.reshape(row.y0, (len(row.k), -1))[:, skip:want] * sign
                if method == "markov":
                    q = q / np.sqrt(row.deg)[:, None]
                yield pd.DataFrame({"k": row.k, "v": list(q)})

    return values[skip:want], t.rows.select("k", "deg", "y0").mapInPandas(rows, "k long, v array<double>")
