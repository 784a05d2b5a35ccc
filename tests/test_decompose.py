import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.whole_stl import mstl, stl
from tidemill.operators import decompose


def walk(n, seed):
    g = np.random.default_rng(seed)
    return np.sin(2 * np.pi * np.arange(n) / 24) * 3 + g.normal(size=n).cumsum() / 10


@pytest.mark.parametrize("n,period,seasonal", [(49, 24, 11), (300, 24, 11), (3000, 24, 11), (5000, 168, 15)])
def test_a_whole_stretch_equals_the_definition(n, period, seasonal):
    y = walk(n, n)
    s, t, a, b = decompose.stl(y, 0, n, period, seasonal)
    s0, t0 = stl(y, period, seasonal)
    assert (a, b) == (0, n) and np.allclose(s, s0, atol=1e-10) and np.allclose(t, t0, atol=1e-10)


@pytest.mark.parametrize("lo,hi", [(0, 6000), (5000, 12000), (15000, 20000)])
def test_a_cut_stretch_equals_the_whole_beyond_its_reach(lo, hi):
    y, n, far = walk(20000, 1), 20000, decompose.reach(24, 11)
    s, t, a, b = decompose.stl(y[lo:hi], lo, n, 24, 11)
    assert a <= (lo and lo + far) and b >= (hi if hi == n else hi - far)
    s0, t0 = stl(y, 24, 11)
    assert np.allclose(s, s0[a:b], atol=1e-10) and np.allclose(t, t0[a:b], atol=1e-10)


def test_blocks_of_many_series_equal_whole_series(spark):
    lengths = {0: 50000, 1: 40, 2: 300, 3: 1, 4: 2, None: 900}
    whole = {k: walk(n, n) for k, n in lengths.items()}
    rows = [(k, i, float(v)) for k, y in whole.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "idx", "y"]).astype({"series_id": "Int64"}).astype(object).where(lambda d: d.notna(), None), "series_id long, idx long, y double")
    out = decompose.decompose(df, "y", (24, 168), block=6250).toPandas()
    assert len(out) == len(rows)
    for k, y in whole.items():
        got = out[out.series_id.isna() if k is None else out.series_id == k].sort_values("idx")
        seasons, trend, resid = mstl(y, (24, 168))
        for p in (24, 168):
            assert np.allclose(got[f"s{p}"], seasons.get(p, np.zeros(len(y))), atol=1e-9), (k, p)
        assert np.allclose(got.trend, trend, atol=1e-9) and np.allclose(got.resid, resid, atol=1e-9), k


def test_no_rows_and_columns_that_are_named_as_results(spark):
    df = spark.range(100).select(F.col("id").alias("idx"), (F.col("id") % 24).cast("double").alias("y"), F.lit("x").alias("trend"), F.lit(7).alias("_at"))
    out = decompose.decompose(df, "y", (24,))
    assert out.columns == ["idx", "y", "_at", "trend", "s24", "resid"]
    assert out.where("_at = 7 and abs(trend + s24 + resid - y) < 1e-9").count() == 100
    assert decompose.decompose(df.where("false"), "y", (24,)).count() == 0
