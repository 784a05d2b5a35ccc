"""Hourly series: grid, transform, differences, lagged pairs, labels by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

SERIES = "series_id"


def _keys(df: DataFrame) -> list[str]:
    return [SERIES] if SERIES in df.columns else []


def hourly(events: DataFrame, time: str = "ts", value: str = "value") -> DataFrame:
    """(datetime, lmp): the mean value of each hour that has events. Means are pre-aggregated before the shuffle."""
    return events.groupBy(*_keys(events), F.date_trunc("hour", time).cast("timestamp_ntz").alias("datetime")).agg(F.avg(value).alias("lmp"))


def indexed(series: DataFrame, pieces: int | None = None) -> DataFrame:
    """Adds ``idx``, the row's position in time, and ``y`` = asinh(lmp). Windows go by position, so gaps do not matter."""
    return ordered.positions(series, ["datetime"], _keys(series), pieces=pieces).withColumn("y", F.asinh("lmp"))


def branches(series: DataFrame, value: str = "y") -> DataFrame:
    """(datetime, lmp, r, dr, idx): the level and its first difference, without the first row."""
    out = lagged(series, value, 1, "_before").withColumn("dr", F.col(value) - F.col("_before")).where("idx > 0")
    return out.select(*_keys(series), "datetime", "lmp", F.col(value).alias("r"), "dr", (F.col("idx") - 1).alias("idx"))


def lagged(series: DataFrame, column: str, lag: int = 1, name: str = "x") -> DataFrame:
    """Adds the value ``lag`` positions before; null for the first rows. Positions (idx) have no gaps."""
    return ordered.previous(series, {name: column}, lag, _keys(series))


def by_series(series: DataFrame, one: DataFrame) -> DataFrame:
    """series joined with one row for each series; without a key, with one row."""
    keys = _keys(series)
    return series.join(one, keys) if keys else series.join(F.broadcast(one))


def autocorrelation(series: DataFrame, column: str, lags: int, block: int = ordered.BLOCK) -> DataFrame:
    """(lag, acf) for lags 0 to ``lags``: sum (x_t - m)(x_t+k - m) / sum (x - m)^2; 0 where there is no variance or too few rows.

    One pass over blocks of positions, each with the next ``lags`` rows of the series: a row's next values are a frame, exploded by lag and summed
    with map-side aggregation.
    """
    keys = _keys(series)
    x = by_series(series.select(*keys, "idx", column), series.groupBy(*keys).agg(F.avg(column).alias("_m")))
    x = x.select(*keys, "idx", (F.col(column) - F.col("_m")).alias("x"))
    x = ordered.framed(x, lambda w: {"ahead": F.collect_list("x").over(w.rowsBetween(0, lags))}, after=lags, keys=keys, block=block)
    sums = x.select(*keys, "x", F.posexplode("ahead").alias("lag", "y")).groupBy(*keys, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    whole = sums.where("lag = 0").select(*keys, F.col("s").alias("_whole"))
    return by_series(sums, whole).select(*keys, "lag", F.when(F.col("_whole") < 1e-15, 0.0).otherwise(F.col("s") / F.col("_whole")).alias("acf"))


def labels_by_hour(series: DataFrame, labels: DataFrame, stride: int = 6) -> DataFrame:
    """Each hour takes the labels of the window that starts at or before it within a stride; hours past the last window take the last one's.

    ``labels`` has window_id from 0 on without gaps. It is an equality join on a computed key.
    """
    keys = _keys(series)
    last = labels.groupBy(*[k for k in keys if k in labels.columns]).agg(F.max("window_id").alias("_last"))
    with_last = series.join(last, keys) if keys and keys[0] in labels.columns else series.join(F.broadcast(last))  # without a series key: one row
    own = F.least(F.floor(F.col("idx") / stride), F.col("_last")).alias("window_id")
    return with_last.select(*series.columns, own).join(labels, [k for k in keys if k in labels.columns] + ["window_id"], "left")


def on_grid(grid: DataFrame, series: DataFrame) -> DataFrame:
    """The series on a generated axis; hours it lacks are null."""
    return grid.join(series, "datetime", "left")
