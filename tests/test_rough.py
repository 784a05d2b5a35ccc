"""Distances by products, and by differences only where products do not tell: medians, degrees."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import eigen, knn, spectral, tiles


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>").repartition(3)


def test_products_keep_their_bound():
    g = np.random.default_rng(1)
    for scale, away in ((1.0, 0.0), (1.0, 1e7), (1e-9, 0.0), (1e-20, 0.0), (1e30, 0.0)):
        x = away + scale * g.normal(size=(700, 64))
        x[5] = x[600]
        for kind in (np.float32, np.float64):
            r = tiles.Rough(x, x, kind)
            true, seen = tiles.apart(x, x) ** 2, 0
            for rows, cols, s in r.pieces(True):
                assert (np.abs(s - true[rows, cols]) <= r.slack).all()
                seen += s.size
                at = np.arange(s.size)[::97]
                assert (r.exact(rows, cols, at) ** 2 == true[rows, cols].ravel()[at]).all()
            assert seen < 700 * 700 and r.slack < 0.01 * np.median(true)


@pytest.mark.parametrize("written", [10**6, 40])
def test_median_is_exact_among_copies_and_far_from_the_origin(spark, written):
    """Copies, distances with many ties, a far origin; values written at once or counted in bins again."""
    g = np.random.default_rng(2)
    far = 1e6 + g.normal(size=(90, 5))
    far[60:] = far[:30]
    for x in (far, g.integers(0, 3, (80, 4)).astype(float), 1e-25 * g.normal(size=(60, 3))):
        d = tiles.apart(x, x)[np.triu_indices(len(x), 1)]
        v = np.sort(d[d > 0])
        r = spectral._summary(tiles.tiles(frame(spark, x), "k", size=16), 16, written)
        assert (r.n, r.least, r.most, r.eps) == (len(v), v[0], v[-1], v[(len(v) - 1) // 2] ** 2)


def test_degrees_of_copies(spark):
    """The greatest value of each row of the kernel is exactly 1, also far from the origin."""
    x = 1e6 + np.random.default_rng(3).normal(size=(120, 64))
    x[100:] = x[:20]
    rows = {r.i: r for r in spectral.kernel_degrees(frame(spark, x), "k", "x", 100.0, size=16).collect()}
    want = np.exp(-(tiles.apart(x, x) ** 2) / 100.0).sum(1)
    assert all(r.diagonal == 1 for r in rows.values()) and [rows[i].degree for i in range(120)] == pytest.approx(want.tolist(), abs=1e-9)


def test_few_products_with_many_equal_directions(spark, monkeypatch):
    """Vectors that spread evenly in 64 dimensions have 64 eigenvalues of about one size: the panel holds them all, so few rounds of products suffice."""
    calls = []
    monkeypatch.setattr(eigen, "multiply", lambda *args, **kw: calls.append(1) or tiles.multiply(*args, **kw))
    t = spectral.standardize_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x")))
    _, values = spectral.diffusion_coordinates(t, "vec_id", "x", 20)
    assert len(values) == 20 and len(calls) <= 16


def test_silhouettes_of_all_dimensions_in_one_pass(spark, monkeypatch):
    """Each equals that of the vectors cut to so many numbers; all share one run over the tiles."""
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 6)) + 2.0 * g.integers(0, 3, 300)[:, None]
    df = frame(spark, x).withColumns({f"l{d}": F.when(F.col("k") % 41 > 0, F.col("k") % d) for d in (2, 3, 5)})
    runs = []
    monkeypatch.setattr(spectral, "over", lambda *args: runs.append(1) or tiles.over(*args))
    got = spectral.silhouettes(df, "k", "x", {5: "l5", 2: "l2", 3: "l3"}, size=64)
    assert len(runs) == 1
    for d, value in zip((5, 2, 3), got, strict=True):
        far, own = tiles.apart(x[:, :d], x[:, :d]), np.where(np.arange(300) % 41 > 0, np.arange(300) % d, -1)
        total = np.stack([far[:, own == c].sum(1) / ((own == c).sum() - (own == c)) for c in range(d)], 1)
        a, b = total[np.arange(300), own], np.where(np.arange(d) == own[:, None], np.inf, total).min(1)
        assert value == pytest.approx(np.where(own < 0, 0, (b - a) / np.maximum(a, b)).mean(), abs=1e-12)


def test_neighbours_compare_few_pairs_by_differences(spark):
    """A bound from products leaves a few times k candidates a row; ties at the k-th distance go by key, also among copies."""
    g = np.random.default_rng(5)
    x = g.normal(size=(2000, 16))
    x[1500:1520] = x[3]
    r = tiles.Rough(x, x, np.float32)
    keys, rows = np.arange(2000), slice(0, 512)
    found = spectral.nearest_of(r, keys, keys, rows, r(rows, slice(0, 2000)), 5)
    d = tiles.apart(x[:512], x)
    for i in range(512):
        want = sorted((d[i, j], j) for j in range(2000) if j != i)[:5]
        assert list(zip(found["dist"][i], found["j"][i], strict=True)) == want


def test_a_row_of_the_index_is_sent_once_to_a_group(spark):
    """Not once for each visited cell: the groups hold each member once, and a hot cell is in several groups."""
    g = np.random.default_rng(6)
    x = np.concatenate([g.normal(0, 0.01, (1500, 3)), g.normal(0, 5, (500, 3))])
    index = knn.build(frame(spark, x), "k", "x", 5, recall=1.0, cells=20)
    index.visit = len(index.at)
    t = knn._grouped(index, 64)
    held = [(r.g, k) for r in t.rows.select("g", "k").collect() for k in r.k]
    assert sorted(k for _, k in held) == list(range(2000))
    assert max(np.bincount([g for g, _ in held])) < 2.5 * 2000 / t.groups
    found = {(r.i, r.j) for r in knn.search(index, 5, size=64).collect()}
    assert found == {(r.i, r.j) for r in spectral.neighbours(frame(spark, x), "k", "x", 5).collect()}


def test_the_filter_takes_no_more_steps_than_the_residuals_need(spark, monkeypatch):
    """Where the wanted values stand far above the rest, as among many rows, a few products do."""
    calls = []
    monkeypatch.setattr(eigen, "multiply", lambda *args, **kw: calls.append(1) or tiles.multiply(*args, **kw))
    x = np.random.default_rng(7).normal(size=(1200, 3))
    dc, values = spectral.diffusion_coordinates(frame(spark, x), "k", "x", 3)
    d = tiles.apart(x, x)
    k = np.exp(-(d**2) / np.quantile(d[np.triu_indices(1200, 1)], 0.5, method="inverted_cdf") ** 2)
    w, v = np.linalg.eigh(k / np.sqrt(np.outer(k.sum(1), k.sum(1))))
    want = v[:, [-2, -3, -4]] / np.sqrt(k.sum(1))[:, None] * w[[-2, -3, -4]]
    got = np.array([r.dc for r in dc.orderBy("k").collect()])
    assert np.abs(values - w[[-2, -3, -4]]).max() < 1e-12
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-9
    assert len(calls) <= 8


def test_groups_send_only_what_the_own_group_does_not_rule_out(spark, monkeypatch):
    """Not k rows of each group for every row; the neighbours and densities stay those of all pairs."""
    sent = []
    monkeypatch.setattr(knn, "over", lambda *args: sent.append(tiles.over(*args)) or sent[0])
    g = np.random.default_rng(8)
    x = np.concatenate([g.normal(c, 1.0, (500, 4)) for c in (0, 20, 40, 60)])
    found = knn.search(knn.build(frame(spark, x), "k", "x", 20, recall=1.0, cells=12), 20, 0.5, size=64).toPandas()
    exact = spectral.neighbours(frame(spark, x), "k", "x", 20, bandwidth=0.5).toPandas()
    both = exact.merge(found, on=["i", "j", "rank"])
    assert len(both) == len(exact) == len(found) == 2000 * 20 and (both.dist_x == both.dist_y).all()
    assert np.abs(both.kde_x - both.kde_y).max() < 1e-9
    assert sent[0].select(F.sum(F.size("j"))).first()[0] < 2000 * 21 * 2


def test_blocks_may_reach_a_tile_in_any_order(spark):
    """As on several executors, where each shuffle brings a group's blocks in an order of its own: a group that meets itself has one order all the same."""

    def mixed(batches):
        yield pd.concat(list(batches), ignore_index=True).sample(frac=1, random_state=int.from_bytes(os.urandom(4), "big"))

    x = np.random.default_rng(10).normal(size=(320, 3))
    t = tiles.tiles(frame(spark, x), "k", size=20, group=160)
    t.rows = t.rows.coalesce(1).mapInPandas(mixed, t.rows.schema)
    d = tiles.apart(x, x)
    for _ in range(3):
        degrees = {k: v for r in tiles.added(t, tiles.multiply(t, 2.0, "degree", None), lambda row, y: {"deg": y}, eigen.BASE).collect() for k, v in zip(r.k, r.deg, strict=True)}
        assert [degrees[i] for i in range(320)] == pytest.approx(np.exp(-(d**2) / 2.0).sum(1).tolist(), abs=1e-9)
    v = np.sort(d[np.triu_indices(320, 1)])
    r = spectral._summary(t, 64)
    assert (r.n, r.least, r.most, r.eps) == (len(v), v[0], v[-1], v[(len(v) - 1) // 2] ** 2)


def test_counts_of_a_tile_do_not_grow_with_its_pieces(spark, monkeypatch):
    """The bins of all pieces, and the values near the median, are counted together; also where nearly all distances are equal."""
    t = spectral.Tally()
    g = np.random.default_rng(12)
    given = [g.integers(5_000 - 40 * i, 9_000 + 30 * i, 3_000) for i in range(60)]
    for at in given:
        t.add(at)
        assert len(t.n) <= 9_000 + 30 * 60 - (5_000 - 40 * 60)
    names, counts = np.unique(np.concatenate(given), return_counts=True)
    assert (t.found()[0] == names).all() and (t.found()[1] == counts).all()
    most, merged = [], spectral._merged
    monkeypatch.setattr(spectral, "APART", 500)
    monkeypatch.setattr(tiles, "CHUNK", 16)

    def watched(parts):
        out = merged(parts)
        most.append((sum(len(p[0]) for p in parts), len(out[0])))
        return out

    monkeypatch.setattr(spectral, "_merged", watched)
    monkeypatch.setattr(spectral, "over", lambda t, f, schema, reads: local(t, f, schema))

    def local(t, f, schema):
        sides = [tiles.Side(p) for _, p in t.rows.toPandas().groupby("g")]
        out = [pd.DataFrame(x) for i, a in enumerate(sides) for b in sides[i:] for x in f(a, b, a is b)]
        return spark.createDataFrame(pd.concat(out), schema)

    simplex = np.eye(150)
    simplex[0] *= 3
    for written in (10**6, 40):
        r = spectral._summary(tiles.tiles(frame(spark, simplex), "k", size=64, group=75), 16, written)
        d = tiles.apart(simplex, simplex)[np.triu_indices(150, 1)]
        assert (r.n, r.least, r.most, r.eps) == (len(d), d.min(), d.max(), np.sort(d)[(len(d) - 1) // 2] ** 2)
    assert max(a for a, _ in most) < 500 + 16 * 16 + 100 and max(b for _, b in most) < 20


@pytest.mark.parametrize("written", [10**6, 40])
def test_degrees_with_blocks_in_any_order(spark, monkeypatch, written):
    """The bandwidth and the degrees of the kernel, with the blocks of a group in another order for each shuffle."""

    def mixed(batches):
        yield pd.concat(list(batches), ignore_index=True).sample(frac=1, random_state=int.from_bytes(os.urandom(4), "big"))

    def dealt(*args):
        t = tiles.tiles(*args[:3], size=16, group=128)
        t.rows = t.rows.coalesce(1).mapInPandas(mixed, t.rows.schema)
        return t

    monkeypatch.setattr(spectral, "tiles", dealt)
    x = np.random.default_rng(16).normal(size=(256, 4))
    d = tiles.apart(x, x)
    v = np.sort(d[np.triu_indices(256, 1)])
    eps = spectral._summary(dealt(frame(spark, x), "k", "x"), 64, written).eps
    assert eps == v[(len(v) - 1) // 2] ** 2
    rows = {r.i: r for r in spectral.kernel_degrees(frame(spark, x), "k", "x", eps).collect()}
    assert [rows[i].degree for i in range(256)] == pytest.approx(np.exp(-(d**2) / eps).sum(1).tolist(), abs=1e-9)
    assert all(r.diagonal == 1 for r in rows.values())
