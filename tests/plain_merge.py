"""Merging by looking at every pair in every round: what the faster way is compared with."""

import math

from tidemill.functions.special import studentized_range_quantile


def absorb_small(groups: dict, min_size: int) -> tuple[dict, dict[int, int]]:
    """Groups that start smaller than ``min_size`` join the group with the nearest current mean, the smallest first."""
    groups, to = dict(groups), {k: k for k in groups}
    for label in sorted(groups, key=lambda k: (groups[k].n, k)):
        first = groups[label].n
        if first >= min_size or len(groups) < 2 or to[label] != label:
            continue
        near = min((k for k in groups if k != label), key=lambda k: (abs(groups[k].mean - groups[label].mean), k))
        groups[near] = groups[near].with_(groups.pop(label))
        to = {k: near if v == label else v for k, v in to.items()}
    return groups, to


def merge_alike(groups: dict, alpha: float) -> tuple[dict, dict[int, int]]:
    """While some pair is not significantly different, the pair with the smallest difference becomes one, under the lower-mean label."""
    groups, to = dict(groups), {k: k for k in groups}
    while len(groups) > 1:
        n, k = sum(g.n for g in groups.values()), len(groups)
        if n <= k:
            break
        mse = sum(g.m2 for g in groups.values()) / (n - k)
        critical = studentized_range_quantile(1 - alpha, k, n - k)
        order = sorted(groups, key=lambda x: (groups[x].mean, x))
        alike = []
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                gap = groups[b].mean - groups[a].mean
                error = math.sqrt(mse / 2 * (1 / groups[a].n + 1 / groups[b].n))
                if gap < critical * error or error == 0 and gap == 0:
                    alike.append((gap, a, b))
        if not alike:
            break
        _, a, b = min(alike)
        groups[a] = groups[a].with_(groups.pop(b))
        to = {x: a if v == b else v for x, v in to.items()}
    return groups, to
