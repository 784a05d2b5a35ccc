"""The parallel merge tree against a sweep over saddles with a union-find, and clusters against the same."""

import numpy as np
import pytest

from tidemill.config import Config
from tidemill.operators import modes, spectral
from tidemill.plans import regime_analysis


def sweep(peaks, meetings):
    root = {p: p for p in peaks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for a, b, s in sorted(meetings, key=lambda m: (-m[2], m[0], m[1])):
        a, b = find(a), find(b)
        if a != b:
            low, high = sorted((a, b), key=lambda p: (peaks[p], -p))
            root[low] = high
            out.append((low, high, s))
    return out


def graph(g, n, edges, levels):
    peaks = {int(p): float(g.integers(0, levels)) + levels for p in range(n)}
    met = {}
    for _ in range(edges):
        a, b = sorted(map(int, g.choice(n, 2, replace=False)))
        met[a, b] = float(g.integers(0, levels))
    return peaks, [(a, b, min(s, peaks[a], peaks[b])) for (a, b), s in met.items()]


def test_merge_tree_equals_the_sweep(spark):
    """Random graphs of many shapes in one call, with ties of peaks and saddles, chains of rising saddles, stars and parts that never meet."""
    g = np.random.default_rng(5)
    cases = [graph(g, n, m, levels) for n, m in ((2, 1), (6, 9), (30, 40), (60, 300), (150, 160)) for levels in (3, 1000)]
    cases += [({p: 1000.0 - p for p in range(60)}, [(p, p + 1, float(p)) for p in range(59)]), ({p: float(p) for p in range(60)}, [(p, p + 1, float(-p)) for p in range(59)])]
    cases += [({p: float(p % 7) for p in range(40)}, [(0, p, float(p % 5)) for p in range(1, 40)]), ({1: 5.0}, [])]
    peaks = spark.createDataFrame([(k, p, f) for k, (ps, _) in enumerate(cases) for p, f in ps.items()], "g int, p long, f double")
    met = spark.createDataFrame([(k, a, b, s) for k, (_, ms) in enumerate(cases) for a, b, s in ms], "g int, a long, b long, saddle double")
    got = {}
    for r in modes.merge_tree(peaks, met).collect():
        got.setdefault(r.g, []).append((r.low, r.high, r.death))
    for k, (ps, ms) in enumerate(cases):
        assert sorted(got.get(k, [])) == sorted(sweep(ps, ms)), k


def test_number_of_modes(spark):
    rows = [(0, k, d) for k, d in enumerate([5.1, 0.1, 5.0, 0.2])] + [(1, 0, 1.0)] + [(2, k, float(k)) for k in range(4)]
    assert modes.mode_counts(spark.createDataFrame(rows, "g int, low long, death double")) == {0: 3, 2: 4}


@pytest.mark.parametrize("n_modes", [3, None])
def test_modes_of_three_blobs(spark, n_modes):
    g = np.random.default_rng(8)
    x = np.concatenate([g.normal(c, 0.4, (80, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>")
    edges = spectral.neighbours(df, "k", "x", 20, bandwidth=0.5).persist()
    labels, n = modes.cluster(edges, n_modes)
    got = labels.orderBy("i").toPandas().label.to_numpy()
    pdf = edges.toPandas()
    f = pdf.groupby("i").kde.first()
    up = {}
    for i, js in pdf.groupby("i").j:
        up[i] = max([i, *js], key=lambda j: (f[j], -j))

    def top(i):
        return i if up[i] == i else top(up[i])

    peak = {i: top(i) for i in f.index}
    met = {}
    for i, j in zip(pdf.i, pdf.j, strict=True):
        a, b = sorted((peak[i], peak[j]))
        if a != b:
            met[a, b] = max(met.get((a, b), -1.0), min(f[i], f[j]))
    peaks = {p: f[p] for p in set(peak.values())}
    died = sweep(peaks, [(a, b, s) for (a, b), s in met.items()])
    deaths = sorted(d for *_, d in died)
    want = n_modes or (len(deaths) - int(np.argmax(np.diff(deaths))) if len(deaths) > 1 else 1)
    assert n == want
    parent = {p: p for p in peaks}
    for low, high, _ in sorted(died, key=lambda d: (peaks[d[0]] - d[2], d[0]))[: max(0, len(peaks) - n)]:
        parent[low] = high

    def end(p):
        return p if parent[p] == p else end(parent[p])

    order = {p: k for k, p in enumerate(sorted({end(p) for p in peaks}, key=lambda p: (-peaks[p], p)))}
    assert got.tolist() == [order[end(peak[i])] for i in sorted(peak)]
    if n_modes:
        assert all(len(set(got[k : k + 80])) == 1 for k in (0, 80, 160)) and len(set(got)) == 3


def test_partition_takes_all_neighbours_and_densities(spark, monkeypatch):
    """Not 95 % of the neighbours and the densities of some cells: vectors that spread evenly have neighbours in every cell; copies count as rows."""
    x = np.random.default_rng(13).normal(size=(900, 12))
    x[850:] = x[:50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "window_id long, dc array<double>").repartition(3)
    seen = []
    monkeypatch.setattr(modes, "search", lambda edges, ks: seen.append((edges, ks)))
    regime_analysis.partition(df, 12, Config())
    edges, ks = seen[0]
    got = edges.toPandas().sort_values(["i", "rank"])
    width = x.std() * 900 ** (-1 / 16)
    want = spectral.neighbours(df, "window_id", "dc", 150, bandwidth=width).toPandas().sort_values(["i", "rank"])
    assert ks == Config().neighbours and len(got) == len(want) == 900 * 150
    assert (got.j.to_numpy() == want.j.to_numpy()).all() and np.abs(got.dist.to_numpy() - want.dist.to_numpy()).max() < 1e-12
    assert np.abs(got.kde.to_numpy() - want.kde.to_numpy()).max() < 1e-9
