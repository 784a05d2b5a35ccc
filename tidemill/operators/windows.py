"""Sliding windows over row positions, and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import TINY, f32, kurtosis
from .series import by_series


def count(n: int, window: int, stride: int) -> int:
    return 0 if n < window else (n - window) // stride + 1


def windows(series: DataFrame, window: int = 512, stride: int = 6) -> DataFrame:
    """Long form (window_id, pos, datetime, r, dr, lmp), complete windows only, values rounded to single precision.

    Each row is sent to the windows that hold it, at most window/stride of them: an
    explode, no join. Rows that no window holds are dropped first, as a
    sequence with its ends swapped would count down.
    """
    keys = [k for k in ("series_id",) if k in series.columns]
    n = series.groupBy(*keys).agg(F.count("*").alias("_n"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("idx") - window + 1) / stride))
    hi = F.least(F.floor(F.col("idx") / stride), F.floor((F.col("_n") - window) / stride))
    held = by_series(series, n).where(F.col("_n") >= window).withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi")
    each = held.withColumn("window_id", F.explode(F.sequence("_lo", "_hi")))
    return each.select(*keys, "window_id", (F.col("idx") - F.col("window_id") * stride).alias("pos"), "datetime", *[f32(F.col(c)).alias(c) for c in ("r", "dr", "lmp")])


def _window_keys(w: DataFrame) -> list[str]:
    return [k for k in ("series_id", "window_id") if k in w.columns]


def with_lag(w: DataFrame, column: str, lag: int, name: str) -> DataFrame:
    return w.withColumn(name, F.lag(column, lag).over(Window.partitionBy(*_window_keys(w)).orderBy("pos")))


def features(w: DataFrame, value: str = "dr", window: int = 512) -> DataFrame:
    """The 15 distribution features of each window and its end time. One shuffle by window serves the lag and the aggregates."""
    x = F.col(value)
    blocks = window // 24 * 24
    w = with_lag(w, value, 1, "_before")
    p = lambda q, c=x: F.percentile(c, F.lit(q))
    step = F.when((F.col("pos") < blocks) & (F.col("pos") % 24 != 0), F.abs(x - F.col("_before")))
    out = w.groupBy(*_window_keys(w)).agg(
        F.max("datetime").alias("datetime"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skew"), kurtosis(x).alias("kurt"), F.min(x).alias("min"), F.max(x).alias("max"),
        (F.max(x) - F.min(x)).alias("range"), p(0.5).alias("median"), p(0.05).alias("p5"), p(0.95).alias("p95"), (p(0.75) - p(0.25)).alias("iqr"),
        (F.avg(step) if blocks else F.avg(F.abs(x - F.col("_before")))).alias("vol_24h"), F.avg("lmp").alias("lmp_mean"), p(0.95, F.col("lmp")).alias("lmp_p95"), F.stddev_pop("lmp").alias("lmp_std"),
    )
    return out


def acf_of(w: DataFrame, column: str = "r", lags: tuple[int, ...] = (1, 6, 24, 168)) -> DataFrame:
    """(window_id, acf_<lag>h ...): biased autocorrelation about the window's mean; 0 without variance."""
    by = Window.partitionBy(*_window_keys(w))
    w = w.withColumn("_x", F.col(column) - F.avg(column).over(by))
    for k in lags:
        w = w.withColumn(f"_x{k}", F.lag("_x", k).over(by.orderBy("pos")))
    total = F.sum(F.col("_x") * F.col("_x"))
    value = lambda k: F.when(total < TINY, 0.0).otherwise(F.coalesce(F.sum(F.col("_x") * F.col(f"_x{k}")), F.lit(0.0)) / total)
    return w.groupBy(*_window_keys(w)).agg(*[value(k).alias(f"acf_{k}h") for k in lags])


def dynamics(w: DataFrame, column: str = "r") -> DataFrame:
    """(window_id, alpha, sigma, sigma_r, peak): pull 1 - acf(1), spread of steps, spread and largest size of values."""
    steps = with_lag(w, column, 1, "_b").groupBy(*_window_keys(w)).agg(F.stddev_pop(F.col(column) - F.col("_b")).alias("sigma"), F.stddev_pop(column).alias("sigma_r"), F.max(F.abs(column)).alias("peak"))
    return acf_of(w, column, (1,)).select(*_window_keys(w), (1 - F.col("acf_1h")).alias("alpha")).join(steps, _window_keys(w))


def targets(w: DataFrame) -> DataFrame:
    """(window_id, datetime, lmp_mean, acf_6h): what the two partitions are merged on."""
    mean = w.groupBy(*_window_keys(w)).agg(F.max("datetime").alias("datetime"), F.avg("lmp").alias("lmp_mean"))
    return mean.join(acf_of(w, "r", (6,)), _window_keys(w))


def as_arrays(w: DataFrame, column: str = "r") -> DataFrame:
    """(window_id, values): each window as one array, in order; for the borders to Python."""
    pairs = F.sort_array(F.collect_list(F.struct("pos", column)))
    return w.groupBy(*_window_keys(w)).agg(F.transform(pairs, lambda x: x[column].cast("float")).alias("values"))


def nearest(stats: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """The k windows with the lowest score, ties by window_id."""
    return stats.withColumn("score", score).orderBy("score", "window_id").limit(k)
