"""K-means of many runs at once: each pass over the rows serves the runs of all dimensions and seeds.

Starts are drawn as in k-means++ (Arthur, Vassilvitskii 2007), one centre of every run a pass: a row's waiting time is exponential with its squared distance to the
nearest centre as rate, and the row of the least time is the next centre. The times come from hashes of the keys, so they do not depend on how rows are dealt. Lloyd's rounds follow
until the centres of a run move by less than ``TOL`` times the spread of its numbers, whatever their scale; runs that have ended leave the pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Sum of the squares of the centres' moves, as a share of the mean variance, below which a run ends; rounds at most.
TOL, MOST = 1e-4, 300


def _matrix(row) -> np.ndarray:
    return np.reshape(row.x, (len(row.k), -1))


def _far(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances to centres, taken from the centres' mean, as what lies far from the origin would lose its digits."""
    middle = at.mean(0)
    x, at = x - middle, at - middle
    return (x * x).sum(1)[:, None] + (at * at).sum(1) - 2 * x @ at.T


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from whole numbers, by the mixer of SplitMix64."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2**53


def _sums(rows: DataFrame, f, width: int) -> np.ndarray:
    """The sum over blocks of the ``width`` numbers that ``f(row)`` gives: one row a task is collected, as a second stage for so few would take as long as the pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for batch in batches:
            for row in batch.itertuples(index=False):
                total += f(row)
        yield pd.DataFrame({"v": [total]})

    return np.sum([np.zeros(width), *rows.mapInPandas(run, "v array<double>").toPandas()["v"]], axis=0)


def _drawn(rows: DataFrame, centres: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """The vector that each run draws as its next centre; one row a run is collected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                x, keys = _matrix(row), np.asarray(row.k)
                for r, at in enumerate(centres):
                    v = x[:, : at.shape[1]]
                    rate = np.min([((v - c) ** 2).sum(1) for c in at], axis=0) if len(at) else np.ones(len(x))
                    wait = -np.log(_uniform(keys, seed * 1_000_003 + r * 1_009 + len(at)))
                    wait = np.where(rate > 0, wait / np.where(rate > 0, rate, 1.0), np.inf)
                    i = np.lexsort((keys, wait))[0]
                    if r not in best or (wait[i], keys[i]) < best[r][:2]:
                        best[r] = (wait[i], keys[i], x[i])
        yield pd.DataFrame([(r, *v) for r, v in best.items()], columns=["r", "wait", "k", "x"])

    found = rows.select("k", "x").mapInPandas(run, "r int, wait double, k long, x array<double>").groupBy("r").agg(F.min(F.struct("wait", "k", "x")).alias("e"))
    return [np.array(e.x) for e in (v.e for v in sorted(found.collect(), key=lambda v: v.r))]


def fitted(rows: DataFrame, dims: list[int], k: int, seeds: int, seed: int = 42) -> dict[int, np.ndarray]:
    """The centres (k, d) of the run of least cost for the first d numbers, for each d of ``dims``, over blocks ``rows`` (k, x)."""
    one = rows.select((F.size("x") / F.size("k")).cast("int").alias("n")).first()
    if one is None or not dims:
        return {d: np.zeros((1, d)) for d in dims}
    # dealt to all cores, as a table of few blocks would be one file, and so one task of each pass
    rows, width = Scratch(rows.sparkSession).save(rows.select("k", "x").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)), one["n"]
    n, *both = _sums(rows, lambda row: np.concatenate([[len(row.k)], _matrix(row).sum(0), (_matrix(row) ** 2).sum(0)]), 1 + 2 * width)
    spread = np.maximum(np.array(both[width:]) / n - (np.array(both[:width]) / n) ** 2, 0.0)
    centres = [np.zeros((0, d)) for d in dims for _ in range(seeds)]
    for _ in range(k):
        centres = [np.vstack([at, x[: at.shape[1]]]) for at, x in zip(centres, _drawn(rows, centres, seed), strict=True)]

    def pass_(open_: list[int]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Sums and numbers of the rows of each centre, and the cost, for some runs."""
        ats = [centres[r] for r in open_]

        def part(row) -> np.ndarray:
            x, out = _matrix(row), []
            for at in ats:
                v = x[:, : at.shape[1]]
                far = _far(v, at)
                own = far.argmin(1)
                hot = (own == np.arange(len(at))[:, None]).astype(float)
                out += [(hot @ v).ravel(), hot.sum(1), [far.min(1).sum()]]
            return np.concatenate(out)

        ends = np.cumsum([at.size + len(at) + 1 for at in ats])
        total = _sums(rows, part, int(ends[-1]))
        return [(v[: at.size].reshape(at.shape), v[at.size : -1], v[-1]) for at, v in zip(ats, np.split(total, ends[:-1]), strict=True)]

    open_ = list(range(len(centres)))
    for _ in range(MOST):
        moved = []
        for r, (sums, held, _) in zip(open_, pass_(open_), strict=True):
            new = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres[r])
            moved += [r] * bool(((new - centres[r]) ** 2).sum() > TOL * spread[: new.shape[1]].mean())
            centres[r] = new
        open_ = moved
        if not open_:
            break
    cost = [c for *_, c in pass_(list(range(len(centres))))]
    return {d: min(zip(cost[i * seeds :], centres[i * seeds : (i + 1) * seeds], strict=False), key=lambda e: e[0])[1] for i, d in enumerate(dims)}


def labelled(df: DataFrame, column: str, centres: dict[str, np.ndarray]) -> DataFrame:
    """``df`` with one column of whole numbers for each set of centres: the nearest centre's number."""
    ats = list(centres.values())

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_list()) if len(v) else np.zeros((0, 1))
        return pd.Series(list(np.stack([_far(x[:, : at.shape[1]], at).argmin(1) for at in ats], 1).astype(np.int32)) if len(v) else [], dtype=object)

    found = df.where(F.col(column).isNotNull()).withColumn("_l", nearest(column))
    return found.withColumns({name: F.get("_l", F.lit(i)) for i, name in enumerate(centres)}).drop("_l")
