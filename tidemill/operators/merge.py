"""Merging of regimes by pairwise comparison of means (Tukey and Kramer).

One group-by gives (n, mean, sum of squares) per label; all further rounds work on
that small table on the driver, as merged groups combine without the rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import studentized_range_quantile


@dataclass
class Group:
    n: int
    mean: float
    m2: float

    def with_(self, other: Group) -> Group:
        n, d = self.n + other.n, other.mean - self.mean
        return Group(n, self.mean + d * other.n / n, self.m2 + other.m2 + d * d * self.n * other.n / n)


def resolved(into: dict[int, int], labels: list[int]) -> dict[int, int]:
    """Where each label ended, from who joined whom; chains are followed once."""
    to = {}
    for label in labels:
        chain = [label]
        while chain[-1] in into and chain[-1] not in to:
            chain.append(into[chain[-1]])
        end = to.get(chain[-1], chain[-1])
        to.update(dict.fromkeys(chain, end))
    return to


def absorb_small(groups: dict[int, Group], min_size: int) -> tuple[dict[int, Group], dict[int, int]]:
    """Groups that are smaller than ``min_size`` at their turn join the group with the nearest current mean, the smallest first.

    Means stay sorted, so that the nearest one is a neighbour.
    """
    groups, into, labels = dict(groups), {}, list(groups)
    places = sorted((g.mean, k) for k, g in groups.items())
    for label in sorted(groups, key=lambda k: (groups[k].n, k)):
        if groups[label].n >= min_size or len(groups) < 2:
            continue
        mean = groups[label].mean
        at = bisect_left(places, (mean, label))
        del places[at]
        near = [places[at]] if at < len(places) else []
        if at:  # of equal means, the lowest label
            near.append(places[bisect_left(places, (places[at - 1][0], -math.inf))])
        goal = min(near, key=lambda x: (abs(x[0] - mean), x[1]))[1]
        del places[bisect_left(places, (groups[goal].mean, goal))]
        into[label], groups[goal] = goal, groups[goal].with_(groups.pop(label))
        insort(places, (groups[goal].mean, goal))
    return groups, resolved(into, labels)


class Critical:
    """Whether a difference of so many standard errors is below the studentized range's quantile for k of n.

    Over the rounds k falls, and with it the quantile, so values at a few k bound all between; only what lies between two bounds asks for a quantile of its own.
    """

    def __init__(self, alpha: float, n: int):
        self.alpha, self.n, self.high, self.low = alpha, n, (0, math.inf), (math.inf, 0.0)

    def at(self, k: int) -> float:
        return studentized_range_quantile(1 - self.alpha, k, self.n - k)

    def bounds(self, k: int) -> tuple[float, float]:
        if k < self.low[0]:
            self.high = (k, self.at(k)) if self.low[0] == math.inf else self.low
            lower = max(2, k * 7 // 8)
            self.low = (lower, self.at(lower))
        return self.low[1], self.high[1]


def closest_alike(label: np.ndarray, n: np.ndarray, mean: np.ndarray, mse: float, critical: Critical) -> tuple[int, int] | None:
    """The places of the pair with the smallest difference of those not significantly different, of groups in order of their means.

    Neighbours are looked at first, then those two places apart, and so on, as long as these can be closer than the best pair.
    """
    k, best, found = len(label), math.inf, None
    sure, maybe = critical.bounds(k)
    widest = maybe * math.sqrt(mse / n.min())
    for lag in range(1, k):
        gap = mean[lag:] - mean[:-lag]
        least = gap.min()
        if least > min(best, widest):
            break
        near = np.flatnonzero(gap <= min(best, widest))
        error = np.sqrt(mse / 2 * (1 / n[near] + 1 / n[near + lag]))
        g = gap[near]
        alike = (g < sure * error) | (error == 0) & (g == 0)
        unsure = ~alike & (g < maybe * error)
        if unsure.any() and (not alike.any() or g[unsure].min() <= g[alike].min()):
            alike |= g < critical.at(k) * error
        near, g = near[alike], g[alike]
        if len(g):
            i = min(near[g == g.min()], key=lambda i: (label[i], label[i + lag]))
            if (g.min(), label[i], label[i + lag]) < (best, *((label[found[0]], label[found[1]]) if found else (0, 0))):
                best, found = g.min(), (i, i + lag)
        if best == 0:
            break  # equal means stand side by side, the lowest label first
    return found


def merge_alike(groups: dict[int, Group], alpha: float) -> tuple[dict[int, Group], dict[int, int]]:
    """While some pair is not significantly different, the pair with the smallest difference becomes one, under the lower-mean label.

    A round costs a few passes over an array of the means.
    """
    groups, into, labels = dict(groups), {}, list(groups)
    order = sorted(groups, key=lambda x: (groups[x].mean, x))
    label, n, mean = np.array(order, dtype=np.int64), np.array([groups[x].n for x in order], float), np.array([groups[x].mean for x in order], float)
    total, m2 = sum(g.n for g in groups.values()), sum(g.m2 for g in groups.values())
    critical = Critical(alpha, total)
    while 1 < len(label) < total:
        pair = closest_alike(label, n, mean, m2 / (total - len(label)), critical)
        if pair is None:
            break
        a, b = (int(label[i]) for i in pair)
        one, other = groups[a], groups.pop(b)
        into[b], groups[a] = a, one.with_(other)
        m2 += groups[a].m2 - one.m2 - other.m2
        label, n, mean = (np.delete(x, pair) for x in (label, n, mean))
        at = np.searchsorted(mean, groups[a].mean)
        while at < len(label) and mean[at] == groups[a].mean and label[at] < a:
            at += 1
        label, n, mean = np.insert(label, at, a), np.insert(n, at, groups[a].n), np.insert(mean, at, groups[a].mean)
    return groups, resolved(into, labels)


def tukey_merge(df: DataFrame, label: str, target: str, alpha: float = 0.05, min_size: int = 20, max_labels: int = 100_000, name: str = "merged") -> DataFrame:
    """Adds ``name``: merged labels from 0 in order of the target's mean; negative labels stay."""
    ok = df.where((F.col(label) >= 0) & F.col(target).isNotNull())
    rows = ok.groupBy(label).agg(F.count("*").alias("n"), F.avg(target).alias("m"), (F.var_pop(target) * F.count("*")).alias("m2")).limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    groups, small = absorb_small({r[label]: Group(r["n"], r["m"], r["m2"]) for r in rows}, min_size)
    groups, alike = merge_alike(groups, alpha)
    rank = {k: i for i, k in enumerate(sorted(groups, key=lambda k: (groups[k].mean, k)))}
    mapping = [(k, rank[alike[v]]) for k, v in small.items()]
    table = df.sparkSession.createDataFrame(mapping, f"{label} int, {name} int") if mapping else df.sparkSession.createDataFrame([], f"{label} int, {name} int")
    return df.withColumn(label, F.col(label).cast("int")).join(F.broadcast(table), label, "left").withColumn(name, F.coalesce(name, F.lit(-1)))  # at most max_labels rows
