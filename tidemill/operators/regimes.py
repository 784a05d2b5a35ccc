"""Diagnostics of partitions: separation, agreement, contingency, ranks, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import TINY
from ..sources.scratch import Scratch
from .ordered import quantiles, ranked


def eta_squared(df: DataFrame, value: str, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """SS between / SS total over rows with labels >= 0; 0 without variance. One row, or one per ``by``.

    Two levels of pre-aggregated sums: per group, then over groups, with centred
    sums of squares (no large squares are subtracted).
    """
    by = by or []
    ok = F.col(value).isNotNull()
    for label in labels:
        ok = ok & (F.col(label) >= 0)
    groups = df.where(ok).groupBy(*by, *labels).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("within"))
    all_ = Window.partitionBy(*[F.col(b) for b in by] or [F.lit(0)])
    grand = F.sum(F.col("n") * F.col("m")).over(all_) / F.sum("n").over(all_)
    parts = groups.withColumn("between", F.col("n") * F.pow(F.col("m") - grand, 2))
    total = F.sum("between") + F.sum("within")
    return parts.groupBy(*by).agg(F.when(total < TINY, 0.0).otherwise(F.sum("between") / total).alias("eta2"))


def eta_table(df: DataFrame, features: list[str], partitions: dict[str, str]) -> DataFrame:
    """(feature, one eta-squared column per partition, rounded to 3 decimals): features unpivoted, one group-by per partition."""
    long = df.select(*partitions.values(), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x"))
    long = long.select(*partitions.values(), "x.feature", "x.value")
    out = None
    for name, label in partitions.items():
        t = eta_squared(long, "value", [label], ["feature"]).select("feature", F.round("eta2", 3).alias(name))
        out = t if out is None else out.join(t, "feature")
    return out


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari`` (Hubert and Arabie 1985); -1 is a label like others. 1 where both partitions are trivial alike."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("n")), cells.groupBy(b).agg(F.sum("n").alias("n"))
    each = [t.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n")).select(F.lit(k).alias("k"), "s", "n") for k, t in (("ij", cells), ("i", rows), ("j", cols))]
    s = each[0].union(each[1]).union(each[2])
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("s")))
    one = s.agg(pick("ij").alias("ij"), pick("i").alias("i"), pick("j").alias("j"), pairs(F.max("n")).alias("all"))
    expected, most = F.col("i") * F.col("j") / F.col("all"), (F.col("i") + F.col("j")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"))


def contingency(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Counts of a by b as columns ``d<value>``, 0 where none; declared values save a pass."""
    wide = df.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select(a, *[F.col(str(v)).alias(f"d{v}") for v in values])


def populated_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 0")


def ranks(df: DataFrame, label: str, value: str, name: str = "rank") -> DataFrame:
    """(label, n, mean, rank): labels ranked from 0 by the mean of a value. The window is over one row per label."""
    means = df.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return means.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mean", label)) - 1)


def relabel(df: DataFrame, label: str, name: str) -> DataFrame:
    """Adds consecutive labels from 0 in label order; negative ones stay. Labels are few, rows are joined."""
    seen = df.where(F.col(label) >= 0).select(label).distinct().withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(label)) - 1)
    return df.join(seen, label, "left").withColumn(name, F.coalesce(name, F.col(label)).cast("int"))


def summary(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """(label, n, share, mean and population deviation of each value) over labelled rows."""
    groups = df.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"), *[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"))])
    return groups.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def box(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, q1, median, q3, low and high whisker, fliers): exact quartiles, whiskers within 1.5 of the interquartile range."""
    ok = df.where((F.col(label) >= 0) & F.col(value).isNotNull())
    q = Scratch(df.sparkSession).save(quantiles(ok, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [label]))
    near = (F.col(value) >= F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) & (F.col(value) <= F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    ends = ok.join(q, label).groupBy(label).agg(F.min(F.when(near, F.col(value))).alias("whisker_low"), F.max(F.when(near, F.col(value))).alias("whisker_high"), F.count_if(~near).alias("fliers"))
    return q.join(ends, label)


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """(high_x, high_y, n, percent): counts below and from the medians of both axes on."""
    medians = df.agg(F.percentile(x, F.lit(0.5)).alias("_mx"), F.percentile(y, F.lit(0.5)).alias("_my"))
    sides = df.join(F.broadcast(medians)).select((F.col(x) >= F.col("_mx")).alias("high_x"), (F.col(y) >= F.col("_my")).alias("high_y"))  # one row
    return sides.groupBy("high_x", "high_y").agg(F.count("*").alias("n")).withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """(bin, n) of equal-width bins from the least to the greatest value; the last bin is closed."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) * bins)).cast("int")
    return df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, std (of a sample), min, the quartiles and max of a column; nulls are left out."""
    one = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    q = quantiles(df, column, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    return one.join(F.broadcast(q), how="left").select("count", "mean", "std", "min", "p25", "p50", "p75", "max")  # one row


def of_cells(cells: DataFrame, value: str, label: str) -> DataFrame:
    """One row: eta2, how far ``label`` tells a value of cells apart, each cell counting once; rho and p, its rank correlation with it."""
    return eta_squared(cells, value, [label]).join(F.broadcast(spearman(cells, label, value)))


def evidence(df: DataFrame, labels: list[str], values: list[str]) -> DataFrame:
    """(label, regime, place, value, n, mean and box) for each partition and value: regimes in order of the partition's own, its first-named, value."""
    out = None
    for label, own in zip(labels, values, strict=True):
        order = ranks(df, label, own, "place").select(label, "place")
        for value in values:
            mean = df.where(F.col(label) >= 0).groupBy(label).agg(F.avg(value).alias("mean"))
            t = box(df, label, value).join(mean, label).join(order, label)
            t = t.select(F.lit(label).alias("partition"), F.concat(F.upper(F.lit(label)), F.col(label)).alias("regime"), "place", F.lit(value).alias("value"), "n", "mean", "q1", "median", "q3", "whisker_low", "whisker_high")
            out = t if out is None else out.union(t)
    return out


def label_of(regime: Column) -> Column:
    """The number in a regime's name, as E3 or D12."""
    return F.substring(regime, 2, 20).cast("int")


def heat_map(cells: DataFrame, rows: DataFrame, columns: DataFrame, value: str, e: str = "e", d: str = "d") -> DataFrame:
    """(e_place, d_place, value) of the cells on axes in the order of two tables (label, rank)."""
    return cells.join(rows.select(e, F.col("rank").alias("e_place")), e).join(columns.select(d, F.col("rank").alias("d_place")), d).select("e_place", "d_place", e, d, "n", value)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for each pair of columns, the later one first: the lower triangle, from one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    row = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def first_middle_last(df: DataFrame, order: Column | str, tie: str) -> DataFrame:
    """The rows at places 0, n // 2 and n - 1 in order, with ``place``. For tables of groups."""
    w = Window.partitionBy(F.lit(0))
    rn, n = F.row_number().over(w.orderBy(order, tie)) - 1, F.count("*").over(w)
    return df.withColumns({"place": rn, "_n": n}).where((F.col("place") == 0) | (F.col("place") == F.floor(F.col("_n") / 2)) | (F.col("place") == F.col("_n") - 1)).drop("_n")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho (correlation of mean ranks) and the two-sided p-value by Student's t. Ranks come from sorted pieces and their offsets."""
    from ..functions.special import student_t_two_sided

    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    row = ranked(ranked(both, "_x", "rx"), "_y", "ry").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho")).first()
    n, rho = row["n"], row["rho"]
    p = None if rho is None or n < 3 else 0.0 if abs(rho) >= 1 else student_t_two_sided(rho * ((n - 2) / (1 - rho * rho)) ** 0.5, n - 2)
    return df.sparkSession.createDataFrame([(n, rho, p)], "n long, rho double, p double")
