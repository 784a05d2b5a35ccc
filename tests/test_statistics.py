import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import special
from tidemill.operators import merge, regime_models, regimes, simulate, spectral


@pytest.mark.parametrize(("k", "df", "q"), [(2, 1e9, 2.772), (2, 1, 17.969), (10, 2, 13.987), (20, 60, 5.241), (2, 30_000, 2.772), (3, 1e9, 3.314), (3, 10, 3.877), (5, 20, 4.232)])
def test_studentized_range_anchors(k, df, q):
    assert special.studentized_range_quantile(0.95, k, df) == pytest.approx(q, abs=2e-3)


def test_tail_probabilities():
    assert special.student_t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.kolmogorov_p(1.36 / math.sqrt(1e6), 10**6) == pytest.approx(0.049, abs=2e-3)


def labelled(spark, seed=0, n=400):
    g = np.random.default_rng(seed)
    e, d = g.integers(-1, 4, n), g.integers(0, 3, n)
    return spark.createDataFrame(pd.DataFrame({"e": e.astype(np.int32), "d": d.astype(np.int32), "v": g.normal(size=n) + e})), e, d


def test_eta_squared(spark):
    df, e, _ = labelled(spark)
    pdf = df.toPandas()
    ok = pdf[pdf.e >= 0]
    between = sum(len(x) * (x.v.mean() - ok.v.mean()) ** 2 for _, x in ok.groupby("e"))
    got = regimes.eta_squared(df, "v", ["e"]).first().eta2
    assert got == pytest.approx(between / ((ok.v - ok.v.mean()) ** 2).sum()) and 0 <= got <= 1
    assert regimes.eta_squared(df.withColumn("v", F.lit(3.0)), "v", ["e"]).first().eta2 == 0


def test_adjusted_rand(spark):
    df, e, d = labelled(spark)
    pairs = lambda x: sum(math.comb(int(n), 2) for n in np.unique(x, return_counts=True)[1])
    ij, i, j, t = pairs(100 * e + d), pairs(e), pairs(d), math.comb(len(e), 2)
    assert regimes.adjusted_rand(df, "e", "d").first().ari == pytest.approx((ij - i * j / t) / ((i + j) / 2 - i * j / t))
    assert regimes.adjusted_rand(df, "e", "e").first().ari == 1
    assert regimes.adjusted_rand(df.withColumn("z", 7 - F.col("e")), "e", "z").first().ari == 1


def test_ar1_recovers_two_regimes(spark):
    g, x, rows = np.random.default_rng(3), 0.0, []
    for i in range(6000):
        e = (i // 200) % 2
        x = (0.95, 0.4)[e] * x + g.normal()
        rows.append((i, x, e, 0))
    hours = spark.createDataFrame(rows, "idx long, lmp double, e int, d int")
    p = regime_models.pairs(hours).persist()
    table = {r.e: r for r in regime_models.cell_table(p, ["e"]).collect()}
    assert table[0].phi == pytest.approx(0.95, abs=0.03) and table[1].phi == pytest.approx(0.4, abs=0.05)
    par = {r.e: r for r in regime_models.simulation_parameters(hours, ["e"]).collect()}
    assert par[0].sigma == pytest.approx(1, abs=0.05)
    c = {r.model: r for r in regime_models.comparison(p, {"one": ["d"], "two": ["e"]}).collect()}
    assert c["two"].bic < c["one"].bic and c["one"].params == 2 and c["two"].params == 4
    eps = regime_models.with_residual(p).where("e = 0").toPandas().eps.to_numpy()
    z = np.sort(eps / eps.std())
    cdf = special.normal_cdf(z)
    n = len(z)
    assert table[0].KS == pytest.approx(max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()), abs=1e-9)
    assert table[0].KS_p == pytest.approx(special.kolmogorov_p(table[0].KS, n), abs=1e-9)
    overall = regime_models.global_summary(p).select("phi", "c", F.col("sig_eps").alias("sigma"))
    sums = simulate.simulate_moments(spark, simulate.hourly_parameters(hours, regime_models.simulation_parameters(hours, ["e"]), overall, ["e"]), 0.0, 40).persist()
    assert sums.count() == 80
    dp = np.diff([r[1] for r in rows])
    assert simulate.pooled_moments(sums).first().std == pytest.approx(dp.std(), rel=0.05)
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, simulate.simulate_moments(spark, simulate.hourly_parameters(hours, regime_models.simulation_parameters(hours, ["e"]), overall, ["e"]), 0.0, 40).collect()))


def test_cell_size_boundary(spark):
    g = np.random.default_rng(5)
    rows = [(i, float(g.normal()), int(i > 30), 0) for i in range(60)]
    p = regime_models.pairs(spark.createDataFrame(rows, "idx long, lmp double, e int, d int"))
    assert [r.e for r in regime_models.cells(p, ["e"]).collect()] == [0]  # 30 rows stay, 29 go


def test_gaussian_bic(spark):
    df, e, _ = labelled(spark, 2)
    pdf = df.toPandas()
    ok = pdf[pdf.e >= 0]
    loglik = sum(-len(x) / 2 * (math.log(2 * math.pi * x.v.var(ddof=0)) + 1) for _, x in ok.groupby("e"))
    r = regime_models.gaussian_bic(df, "v", {"E": ["e"]}, "e").first()
    assert r.loglik == pytest.approx(loglik) and r.bic == pytest.approx(8 * math.log(len(ok)) - 2 * loglik)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.floats(-50, 50), min_size=2, max_size=30), min_size=2, max_size=6))
def test_merge_leaves_no_alike_pair(samples):
    groups = {k: merge.Group(len(x), float(np.mean(x)), float(np.var(x) * len(x))) for k, x in enumerate(samples)}
    left, to = merge.merge_alike(groups, 0.05)
    assert set(to.values()) == set(left) and sum(g.n for g in left.values()) == sum(map(len, samples))
    n, k = sum(g.n for g in left.values()), len(left)
    if k > 1 and n > k:
        mse = sum(g.m2 for g in left.values()) / (n - k)
        q = special.studentized_range_quantile(0.95, k, n - k)
        for a, b in itertools.combinations(left.values(), 2):
            assert abs(a.mean - b.mean) >= q * math.sqrt(mse / 2 * (1 / a.n + 1 / b.n)) * (1 - 1e-6)


def test_tukey_merge_absorbs_and_keeps_unlabelled(spark):
    g = np.random.default_rng(6)
    rows = [(0, float(x)) for x in g.normal(0, 1, 200)] + [(1, float(x)) for x in g.normal(0, 1, 200)] + [(2, float(x)) for x in g.normal(9, 1, 19)] + [(3, float(x)) for x in g.normal(10, 1, 20)] + [(-1, 5.0)]
    out = {(r.label, r.merged) for r in merge.tukey_merge(spark.createDataFrame(rows, "label int, target double"), "label", "target").collect()}
    assert out == {(0, 0), (1, 0), (2, 1), (3, 1), (-1, -1)}


def test_silhouette_and_neighbours_of_blobs(spark):
    g = np.random.default_rng(7)
    x = np.concatenate([g.normal(c, 0.3, (60, 3)) for c in (0, 4, 8)])
    df = spark.createDataFrame([(i, v.tolist(), i // 60) for i, v in enumerate(x)], "k long, x array<double>, label int")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    label = np.arange(180) // 60
    a = np.array([d[i, label == label[i]].sum() / 59 for i in range(180)])
    b = np.array([min(d[i, label == c].mean() for c in range(3) if c != label[i]) for i in range(180)])
    assert spectral.silhouette(df, "k", "x", "label").first()[0] == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    edges = spectral.neighbours(df, "k", "x", 4, size=50).toPandas()
    for i in (0, 77, 179):
        want = sorted((d[i, j], j) for j in range(180) if j != i)[:4]
        assert [j for _, j in want] == edges[edges.i == i].sort_values("rank").j.tolist()


def test_standardize_constant_column(spark):
    out = spectral.standardize(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert sorted((r.a, r.b) for r in out) == [(-1.0, 0.0), (1.0, 0.0)]


def test_silhouette_covers_all_rows(spark):
    g = np.random.default_rng(6)
    label = g.integers(0, 3, 2600)
    x = g.normal(size=(2600, 4)) + 1.5 * label[:, None]
    df = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label))], "k long, x array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    means = np.stack([d[:, label == c].sum(1) / ((label == c).sum() - (label == c)) for c in range(3)], 1)
    a = means[np.arange(2600), label]
    means[np.arange(2600), label] = np.inf
    b = means.min(1)
    assert spectral.silhouette(df, "k", "x", "label").first()[0] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-9)


def test_blocks_of_distances_equal_a_matrix(spark):
    """Repeated rows, null vectors and blocks of few rows; the median is exact at even and odd numbers of pairs."""
    g = np.random.default_rng(2)
    for n in (1, 2, 9, 30):
        x = g.integers(0, 4, (n, 3)).astype(float)
        df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (99, None)], "k long, x array<double>")
        d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
        v = np.sort(d[np.triu_indices(n, 1)])
        v = v[v > 0]
        r = spectral.pair_summary(df, "k", "x", size=4, bins=8).first()
        assert r.n == len(v)
        if not len(v):
            assert r.eps is None
            continue
        assert (r.least, r.most, r.eps) == (v[0], v[-1], pytest.approx(v[(len(v) - 1) // 2] ** 2))
        rows = {r.i: r for r in spectral.kernel_degrees(df, "k", "x", r.eps, size=4).collect()}
        assert [rows[i].degree for i in range(n)] == pytest.approx(np.exp(-(d**2) / r.eps).sum(1).tolist()) and len(rows) == n
        near = {}
        for e in spectral.neighbours(df, "k", "x", 3, size=4).collect():
            near.setdefault(e.i, {})[e["rank"]] = e.j
        for i in range(n):
            assert [near[i][q] for q in sorted(near[i])] == sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:3]
