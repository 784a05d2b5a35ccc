"""Positions, frames, running values, recursions and ranks over pieces against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import ordered, regimes, series


@pytest.fixture(scope="module")
def table(spark):
    g = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"series_id": g.choice(["a", "b", "hot"], n, p=[0.01, 0.19, 0.8]), "t": g.permutation(n), "v": g.normal(size=n).round(1), "f": g.uniform(-1, 1, n)})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("keys", [[], ["series_id"]])
@pytest.mark.parametrize("pieces", [1, 7, None])
def test_positions_have_no_gaps(table, keys, pieces):
    df, pdf = table
    got = ordered.positions(df, ["t"], keys, "idx", pieces).toPandas()
    for _, g in got.groupby("series_id") if keys else [(0, got)]:
        assert g.sort_values("t").idx.tolist() == list(range(len(g)))
    assert len(got) == len(pdf)
    assert ordered.positions(df.where("t < 0"), ["t"], keys).count() == 0


@pytest.mark.parametrize("keys", [[], ["series_id"]])
@pytest.mark.parametrize("block", [4, 100, 10_000])
def test_frames_cross_blocks(table, keys, block):
    df, _ = table
    at = ordered.positions(df, ["t"], keys, pieces=5).persist()
    want = at.toPandas().sort_values("idx")
    by = want.groupby("series_id") if keys else want.groupby(lambda _: 0)
    want["p9"] = by.v.shift(9)
    want["run"], want["top"] = by.v.cumsum(), by.v.cummax().shift(1) if not keys else by.v.transform(lambda v: v.cummax().shift(1))
    state = {}
    for i, r in want.iterrows():
        k = r.series_id if keys else 0
        state[k] = r.f * state.get(k, 2.5) + r.v
        want.loc[i, "x"] = state[k]
    got = ordered.previous(at, {"p9": "v"}, 9, keys, block=block)
    got = ordered.running(got, {"run": ("sum", "v")}, keys, block=block)
    got = ordered.running(got, {"top": ("max", "v")}, keys, block=block, itself=False)
    got = ordered.recursion(got, "f", "v", 2.5, "x", keys, block=block).toPandas()
    both = want.merge(got, on=["series_id", "t", "idx"])
    assert len(both) == len(want)
    for c in ("p9", "run", "top", "x"):
        assert np.allclose(both[f"{c}_x"], both[f"{c}_y"], atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("keys", [[], ["series_id"]])
def test_ranks_share_ties(table, keys):
    df, pdf = table
    with_nulls = df.withColumn("v", F.when(F.col("t") % 50 > 0, F.col("v")))
    got = ordered.ranked(with_nulls, "v", keys=keys, pieces=6).toPandas().sort_values("t")
    ok = pdf.sort_values("t").assign(v=lambda p: p.v.where(p.t % 50 > 0))
    want = (ok.groupby("series_id").v if keys else ok.v).rank()
    assert np.allclose(got["rank"], want, equal_nan=True) and len(got) == len(pdf)


def test_spearman_with_p(table):
    df, pdf = table
    r = regimes.spearman(df.withColumn("w", F.col("v") + 20 * F.col("f")), "v", "w").first()
    w = pdf.v + 20 * pdf.f
    rho = np.corrcoef(pdf.v.rank(), w.rank())[0, 1]
    assert r.n == len(pdf) and r.rho == pytest.approx(rho) and 0 <= r.p <= 1


def test_no_task_holds_the_series(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    b = series.branches(series.indexed(series.hourly(events)))
    assert "SinglePartition" not in b._jdf.queryExecution().executedPlan().toString()
    x = b.toPandas().sort_values("idx").r.to_numpy()
    x = x - x.mean()
    for block in (50, 1 << 16):
        acf = {r.lag: r.acf for r in series.autocorrelation(b, "r", 60, block=block).collect()}
        assert acf == pytest.approx({k: (x[: len(x) - k] * x[k:]).sum() / (x * x).sum() for k in range(61)})
