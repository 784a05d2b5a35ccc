import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import scalar
from tidemill.operators import decompose, regimes, series, windows


def frame(spark, values, name="lmp"):
    t = pd.date_range("2024-01-01", periods=len(values), freq="h")
    return spark.createDataFrame(pd.DataFrame({"datetime": t, name: np.asarray(values, float)})).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


def prepared(spark, values):
    return series.branches(series.indexed(frame(spark, values)))


def test_window_bounds_and_count(spark):
    w = windows.windows(prepared(spark, np.arange(1025)), 512, 6)
    rows = w.groupBy("window_id").agg(F.count("*").alias("n"), F.min("lmp").alias("lo"), F.max("lmp").alias("hi")).orderBy("window_id").collect()
    assert len(rows) == windows.count(1024, 512, 6) == 86
    assert all((r.n, r.lo, r.hi) == (512, 1 + 6 * r.window_id, 512 + 6 * r.window_id) for r in rows)


def test_short_series_has_no_window(spark):
    assert windows.windows(prepared(spark, np.arange(512)), 512, 6).count() == 0 == windows.count(511, 512, 6)


def test_features_match_numpy(spark):
    g = np.random.default_rng(0)
    y = np.cumsum(g.normal(size=700)) + 40
    p = prepared(spark, y)
    pdf = p.orderBy("idx").toPandas()
    w = windows.windows(p, 512, 6).persist()
    rows = windows.features(w).orderBy("window_id").toPandas()
    acf = windows.acf_of(w).orderBy("window_id").toPandas()
    assert len(rows) == windows.count(699, 512, 6)
    for i in (0, len(rows) - 1):
        dr, lmp, r = (pdf[c].to_numpy()[6 * i : 6 * i + 512].astype(np.float32).astype(float) for c in ("dr", "lmp", "r"))
        m, s = dr.mean(), dr.std()
        blocks = dr[:504].reshape(21, 24)
        want = {
            "mean": m, "std": s, "skew": ((dr - m) ** 3).mean() / s**3, "kurt": ((dr - m) ** 4).mean() / s**4, "min": dr.min(), "max": dr.max(), "range": np.ptp(dr), "median": np.median(dr), "p5": np.percentile(dr, 5),
            "p95": np.percentile(dr, 95), "iqr": np.percentile(dr, 75) - np.percentile(dr, 25), "vol_24h": np.abs(np.diff(blocks, axis=1)).mean(), "lmp_mean": lmp.mean(), "lmp_p95": np.percentile(lmp, 95), "lmp_std": lmp.std(),
        }
        for k, v in want.items():
            assert rows[k][i] == pytest.approx(v, abs=1e-9), k
        x = r - r.mean()
        for k in (1, 6, 24, 168):
            assert acf[f"acf_{k}h"][i] == pytest.approx((x[:-k] * x[k:]).sum() / (x * x).sum(), abs=1e-9)


def test_constant_series_has_no_correlation(spark):
    w = windows.windows(prepared(spark, np.ones(600)), 512, 6)
    assert {r.acf_6h for r in windows.acf_of(w).collect()} == {0.0}
    assert {round(r.alpha, 9) for r in windows.dynamics(w).collect()} == {1.0}
    assert {r.acf for r in series.autocorrelation(prepared(spark, np.ones(50)), "r", 5).collect()} == {0.0}


def test_series_are_independent(spark):
    a = prepared(spark, np.arange(600)).withColumn("series_id", F.lit(1))
    b = prepared(spark, np.arange(560)).withColumn("series_id", F.lit(2))
    n = {r.series_id: r.n for r in windows.targets(windows.windows(a.union(b), 512, 6)).groupBy("series_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: windows.count(599, 512, 6), 2: windows.count(559, 512, 6)}


def test_hours_take_the_window_that_starts_there(spark):
    p = prepared(spark, np.arange(560))
    labels = windows.targets(windows.windows(p, 512, 6)).select("window_id")
    got = {r.idx: r.window_id for r in series.labels_by_hour(p, labels).collect()}
    last = windows.count(559, 512, 6) - 1
    assert got == {i: min(i // 6, last) for i in range(559)}


@pytest.mark.parametrize(("phi", "want"), [(0.5, 1.0), (1.0, math.inf), (-0.5, 1.0), (0.0, None), (2.0, math.inf)])
def test_half_life(spark, phi, want):
    got = spark.range(1).select(scalar.half_life(F.lit(phi)).alias("x")).first().x
    assert got == want
    assert spark.range(1).select(scalar.half_life(F.lit(phi), 9999.0, positive=True).alias("x")).first().x == (1.0 if abs(phi) == 0.5 else 9999.0)


def test_normal_cdf(spark):
    x = [-9.0, -5.5, -3.0, -1.0, 0.0, 0.3, 2.0, 5.0, 5.1, 8.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in x], "x double").select(scalar.normal_cdf(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], atol=1e-10)


def test_decomposition_adds_up_and_finds_the_day(spark):
    t = np.arange(24 * 30)
    g = np.random.default_rng(1)
    y = 5 * np.sin(2 * np.pi * t / 24) + 0.01 * t + g.normal(0, 0.1, len(t))
    out = decompose.decompose(series.indexed(frame(spark, y)).withColumn("y", F.col("lmp")), "y", (24, 168, 8760)).orderBy("idx").toPandas()
    assert np.allclose(out.trend + out.s24 + out.s168 + out.s8760 + out.resid, out.y)
    assert (out.s8760 == 0).all() and np.corrcoef(out.s24, np.sin(2 * np.pi * t / 24))[0, 1] > 0.99 and out.resid.std() < 0.3


def test_ranks_and_middle(spark):
    t = spark.createDataFrame([(5, 1.0), (5, 3.0), (2, 9.0), (7, 0.0), (-1, 4.0)], "label int, v double")
    assert {r.label: r["rank"] for r in regimes.ranks(t, "label", "v").collect()} == {7: 0, 5: 1, 2: 2}
    assert {r.label: r.d for r in regimes.relabel(t, "label", "d").collect()} == {2: 0, 5: 1, 7: 2, -1: -1}
    v = spark.createDataFrame([(i, float(i)) for i in range(7)], "k int, v double")
    assert [(r.k, r.place) for r in regimes.first_middle_last(v, "v", "k").orderBy("k").collect()] == [(0, 0), (3, 3), (6, 6)]
