"""Eigenpairs against dense solvers, tiles, the neighbour index against all pairs, silhouettes with bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import knn, lloyd, spectral, tiles

SF = "/root/testdata"


def dense(x, count, method):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    v = np.sort(d[np.triu_indices(len(x), 1)])
    v = v[v > 0]
    k = np.exp(-(d**2) / v[(len(v) - 1) // 2] ** 2)
    deg = k.sum(1)
    if method == "markov":
        values, vectors = np.linalg.eigh(k / np.sqrt(deg[:, None] * deg))
        vectors = vectors / np.sqrt(deg)[:, None]
    else:  # a solver that reads the lower triangle
        values, vectors = np.linalg.eigh(k / deg[:, None], UPLO="L")
    at = np.argsort(values)[::-1][1 : count + 1]
    return values[at], vectors[:, at] * values[at]


def check(spark, x, keys, count, method):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x, strict=True)] + [(10**6, None)], "k long, x array<double>").repartition(3)
    dc, values = spectral.diffusion_coordinates(df, "k", "x", count, method)
    got = {r.k: r.dc for r in dc.collect()}
    assert len(got) == len(x)
    order = np.argsort(keys)
    want, coords = dense(x[order], count, method)
    found = np.array([got[k] for k in np.array(keys)[order]])
    assert np.abs(values - want).max() < 1e-6
    sign = np.sign((found * coords).sum(0))
    assert np.abs(found - coords * sign).max() < 1e-6


@pytest.mark.parametrize("method", ["markov", "lower_triangle"])
def test_eigenpairs_of_blobs_equal_a_dense_solver(spark, method):
    g = np.random.default_rng(1)
    x = np.concatenate([g.normal(c, 0.8, (60, 3)) for c in (0, 3, 7)])
    check(spark, x, g.permutation(1000)[:180].tolist(), 6, method)


def test_eigenpairs_over_all_rows_of_the_embeddings(spark):
    """2,000 vectors of 64 numbers: no landmark, every row takes part."""
    t = spark.read.parquet(f"{SF}/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.array(t.embedding.tolist(), float)
    check(spark, (x - x.mean(0)) / x.std(0), t.vec_id.tolist(), 20, "markov")


def test_few_rows_and_equal_rows(spark):
    g = np.random.default_rng(2)
    make = lambda x: spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "k long, x array<double>")
    for n in (3, 5, 12):
        x = g.normal(size=(n, 2))
        dc, values = spectral.diffusion_coordinates(make(x), "k", "x", 20)
        want, _ = dense(x, 20, "markov")
        assert len(values) == n - 1 and np.abs(values - want).max() < 1e-9 and dc.count() == n
    dc, values = spectral.diffusion_coordinates(make([[1.0, 2.0]] * 40), "k", "x", 5)
    assert dc.count() == 40 and np.abs(values).max() < 1e-9
    dc, values = spectral.diffusion_coordinates(make([[1.0], [2.0]]), "k", "x", 5)
    assert not len(values) and dc.count() == 2


def test_each_pair_of_rows_meets_in_one_tile(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(137)], "k long, x array<double>")
    t = tiles.tiles(df, "k", "x", size=10, group=20)
    assert t.groups >= 7

    def pairs(a, b, same):
        for i in a.k:
            yield {"a": [min(i, j) for j in b.k if not same or i < j], "b": [max(i, j) for j in b.k if not same or i < j]}

    met = [(r.a, r.b) for r in tiles.over(t, pairs, "a long, b long").collect()]
    assert len(met) == len(set(met)) == 137 * 136 // 2


def test_index_finds_neighbours_and_copies(spark):
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(c, 0.5, (300, 3)) for c in (0, 3, 6)]).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[7].tolist()) for i in range(60)] + [(3000 + i, x[500].tolist()) for i in range(2)] + [(5000, None)]
    df = spark.createDataFrame(rows, "k long, x array<double>")
    exact = spectral.neighbours(df, "k", "x", 6, bandwidth=0.7).toPandas()
    whole = knn.search(knn.build(df, "k", "x", 6, recall=1.0, cells=9), 6, 0.7, size=40).toPandas()
    both = exact.merge(whole, on=["i", "j", "rank"])
    assert len(both) == len(exact) == len(whole) and np.abs(both.dist_x - both.dist_y).max() < 1e-9
    index = knn.build(df, "k", "x", 6, recall=0.9, cells=30)
    near = knn.search(index, 6).toPandas()
    asked = exact[exact.i % 100 == 0]
    assert index.visit < 30 and len(asked.merge(near, on=["i", "j"])) >= 0.9 * len(asked)
    # work below all pairs: members a query is compared with
    held = {r.cell: r.n for r in index.members.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert sum(sorted(held.values())[-index.visit :]) < 0.75 * len(rows)
    assert knn.search(knn.build(df.where("k < 0"), "k", "x", 6), 6).count() == 0
    assert knn.search(knn.build(df.where("k < 1"), "k", "x", 6), 6).count() == 0


def test_index_recall_on_the_embeddings(spark):
    t = spark.read.parquet(f"{SF}/sf0.1/embeddings.parquet")
    index = knn.build(t, "vec_id", "embedding", 5, recall=0.95)
    exact = spectral.neighbours(t, "vec_id", "embedding", 5).where("i % 100 = 0").toPandas()
    found = knn.search(index, 5).where("i % 100 = 0").toPandas()
    assert len(exact) == 5 * 20 and len(exact.merge(found, on=["i", "j"])) >= 0.9 * len(exact) and index.visit < len(index.at)


def test_bound_of_the_silhouette_holds(spark):
    g = np.random.default_rng(4)
    label = g.choice(4, 1500, p=[0.6, 0.3, 0.09, 0.01])
    x = g.normal(size=(1500, 3)) + 1.2 * label[:, None]
    df = spark.createDataFrame([(k, v.tolist(), int(c) if k % 50 else None) for k, (v, c) in enumerate(zip(x, label, strict=True))], "k long, x array<double>, label int").persist()
    exact = spectral.silhouette(df, "k", "x", "label").first()[0]
    for seed in range(20):
        r = spectral.silhouette_estimate(df, "k", "x", "label", most=150, seed=seed).first()
        assert abs(r.silhouette - exact) <= r.bound and r.bound < 0.3
    full = spectral.silhouette_estimate(df, "k", "x", "label", most=10**6).first()
    assert full.bound == 0 and full.silhouette == pytest.approx(exact, abs=1e-9)
    assert spectral.silhouette_estimate(df.withColumn("label", F.lit(1)), "k", "x", "label").first().silhouette == 0


def test_vectors_are_standardised_by_one_group_by_on_positions(spark):
    """Not by two aggregates for each of 1,024 positions, whose plan costs more than the rows; the first row may have no vector."""
    x = np.random.default_rng(9).normal(size=(50, 1024)).round(3)
    x[:, 5] = 7.0
    rows = [(0, None)] + [(i + 1, v.tolist()) for i, v in enumerate(x)]
    df = spectral.standardize_vectors(spark.createDataFrame(rows, "k long, x array<double>").coalesce(1))
    got = {r.k: r.x for r in df.collect()}
    sd = x.std(0)
    want = (x - x.mean(0)) / np.where(sd > 1e-9, sd, 1.0)
    assert got[0] is None and len(got) == 51
    assert np.abs(np.array([got[i + 1] for i in range(50)]) - want).max() < 1e-9
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert spectral.standardize_vectors(df.where("k < 0")).count() == 0


def lloyd_rounds(x, label, most):
    for _ in range(most):
        at = np.stack([x[label == c].mean(0) for c in np.unique(label)])
        far = ((x[:, None] - at) ** 2).sum(2)
        label = far.argmin(1)
    return far.min(1).sum(), label


def test_k_means_ends_where_no_round_helps_at_any_scale(spark):
    """Diffusion coordinates are as small as 1e-6, where a bound on the centres' moves in plain numbers ends every run at its first round."""
    x = np.random.default_rng(14).normal(size=(900, 3))
    labels = []
    for scale in (1.0, 2.0**-20):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x * scale)], "window_id long, dc array<double>").repartition(3)
        got = spectral.k_means(df, 3, 6, 2).orderBy("window_id").toPandas()
        labels.append(got.label.to_numpy())
        assert np.stack(got.x).tolist() == (x * scale).tolist()
    first, _ = lloyd_rounds(x, labels[1], 1)
    last, _ = lloyd_rounds(x, labels[1], 60)
    assert len(set(labels[1])) == 6 and first < 1.002 * last and (labels[0] == labels[1]).all()


def test_runs_of_k_means_share_their_passes(spark, monkeypatch):
    """Three dimensions of four runs each take one pass a round; blobs are found, and copies of one row do no harm."""
    g = np.random.default_rng(15)
    own = g.integers(0, 4, 400)
    x = 1e-5 * (np.eye(5)[own] * 9 + g.normal(size=(400, 5)))
    x[own == 3] = x[np.flatnonzero(own == 3)[0]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, dc array<double>")
    passes, sums = [], lloyd._sums
    monkeypatch.setattr(lloyd, "_sums", lambda *args: passes.append(1) or sums(*args))
    at = lloyd.fitted(tiles.tiles(df, "k", "dc", size=64).rows, [3, 4, 5], 4, 4)
    assert len(passes) < 40 and {d: v.shape for d, v in at.items()} == {d: (4, d) for d in (3, 4, 5)}
    found = lloyd.labelled(df, "dc", {"a": at[4], "b": at[5]}).orderBy("k").toPandas()
    for name in "ab":
        assert len(set(zip(own, found[name], strict=True))) == 4
    one = lloyd.fitted(tiles.tiles(df.withColumn("dc", F.array(F.lit(1.0), F.lit(2.0))), "k", "dc").rows, [2], 3, 2)
    assert (one[2] == [1.0, 2.0]).all()
