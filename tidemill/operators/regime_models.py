"""First-order autoregressive models by regime, and model comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import TINY, half_life, half_life_of_alpha, kurtosis, normal_cdf, winner
from ..sources.scratch import Scratch
from .ordered import positions, running
from .series import lagged

UNDEFINED = 9999.0
SALTS = 32


def pairs(hours: DataFrame, price: str = "lmp") -> DataFrame:
    """Adds y = price, x = the price an hour before, dp = y - x; rows without one go. One window per series."""
    return lagged(hours.withColumn("y", F.col(price)), "y").where("x is not null").withColumn("dp", F.col("y") - F.col("x"))


def global_fit(p: DataFrame) -> DataFrame:
    """One row: n, phi, c."""
    return p.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("phi"), F.regr_intercept("y", "x").alias("c"))


def with_residual(p: DataFrame, name: str = "eps") -> DataFrame:
    """Adds the residual of the global model; its two coefficients are one broadcast row."""
    g = global_fit(p).select(F.col("phi").alias("_phi"), F.col("c").alias("_c"))
    return p.join(F.broadcast(g)).withColumn(name, F.col("y") - F.col("_c") - F.col("_phi") * F.col("x")).drop("_phi", "_c")


def global_summary(p: DataFrame) -> DataFrame:
    """One row: n, phi, c, half_life, sig_dp, sig_eps, kurt of the residuals."""
    stats = with_residual(p).agg(F.stddev_pop("dp").alias("sig_dp"), F.stddev_pop("eps").alias("sig_eps"), kurtosis(F.col("eps")).alias("kurt"))
    return global_fit(p).join(F.broadcast(stats)).withColumn("half_life", half_life(F.col("phi")))


def _labelled(p: DataFrame, labels: list[str]) -> DataFrame:
    for label in labels:
        p = p.where(F.col(label) >= 0)
    return p


def cells(p: DataFrame, labels: list[str], min_hours: int = 30) -> DataFrame:
    """Per cell: n, phi re-fitted in the cell, half_life, sig_dp, and sig_eps, kurt of the global model's residuals.

    Cells of fewer than ``min_hours`` rows or without variance go.
    """
    g = _labelled(with_residual(p), labels).groupBy(*labels).agg(
        F.count("*").alias("n"), F.var_samp("x").alias("_v"), F.regr_slope("y", "x").alias("phi"), F.stddev_pop("dp").alias("sig_dp"), F.stddev_pop("eps").alias("sig_eps"), kurtosis(F.col("eps")).alias("kurt")
    )
    return g.where((F.col("n") >= min_hours) & (F.col("_v") > TINY)).withColumn("half_life", half_life(F.col("phi"), UNDEFINED, positive=True)).drop("_v")


def ks_distance(p: DataFrame, labels: list[str]) -> DataFrame:
    """Per cell: n and the Kolmogorov-Smirnov distance of eps / sigma, scaled but not centred, from a standard normal; 1 without spread.

    Values are counted and put in order in pieces, so no task holds a cell; rows meet the cell's spread by salted keys. Null residuals are left out.
    """
    s = Scratch(p.sparkSession)
    e = s.save(_labelled(with_residual(p), labels).where("eps is not null").select(*labels, "eps"))
    sizes = e.groupBy(*labels).agg(F.stddev_pop("eps").alias("_s"), F.count("*").alias("n"))
    counts = e.groupBy(*labels, "eps").agg(F.count("*").alias("_c"))
    placed = running(positions(counts, ["eps"], labels, "_at"), {"_upto": ("sum", "_c")}, labels, "_at")
    spread = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = placed.withColumn("_salt", F.pmod("_at", F.lit(SALTS)).cast("int")).join(spread, [*labels, "_salt"])
    phi = normal_cdf(F.col("eps") / F.col("_s"))
    gap = F.greatest(F.col("_upto") / F.col("n") - phi, phi - (F.col("_upto") - F.col("_c")) / F.col("n"))
    return rows.groupBy(*labels).agg(F.max("n").alias("n"), F.max(F.when(F.col("_s") > TINY, gap).otherwise(1.0)).alias("KS"))


def kolmogorov_p(d: Column, n: Column) -> Column:
    """Asymptotic p-value of a distance, with Stephens' correction; a short alternating series."""
    t = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * t * t))
    return F.when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))))


def cell_table(p: DataFrame, labels: list[str], min_hours: int = 30) -> DataFrame:
    """labels, n, phi, half_life, sig_dp, sig_eps, kurt, KS, KS_p; without spread KS is 1 and KS_p 0."""
    ks = ks_distance(p, labels).select(*labels, "KS", F.when(F.col("KS") >= 1, 0.0).otherwise(kolmogorov_p(F.col("KS"), F.col("n"))).alias("KS_p"))
    return cells(p, labels, min_hours).join(ks, labels).select(*labels, "n", "phi", "half_life", "sig_dp", "sig_eps", "kurt", "KS", "KS_p")


def cascade(e_table: DataFrame, ed_table: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: kurtosis globally, mean over E, mean over E x D, and shares in percent of cells with KS_p > 0.05."""
    share = 100 * F.avg((F.col("KS_p") > 0.05).cast("int"))
    e = e_table.agg(F.avg("kurt").alias("kurt_E"), share.alias("ks_pass_E"))
    ed = ed_table.agg(F.avg("kurt").alias("kurt_ED"), share.alias("ks_pass_ED"))
    return summary.select(F.col("kurt").alias("kurt_global")).join(F.broadcast(e)).join(F.broadcast(ed))


def ranges_inside(ed_table: DataFrame, e: str = "e") -> DataFrame:
    """Per E of two cells or more: the range of phi and of sig_dp over its cells."""
    return ed_table.groupBy(e).agg(F.count("*").alias("n_cells"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("phi", "sig_dp") for f in (F.min, F.max)]).where("n_cells > 1")


def fitted_residuals(p: DataFrame, labels: list[str], min_hours: int = 30, name: str = "eps_cell") -> DataFrame:
    """Adds the residual of the cell's own model; null where the cell is too small, flat or unlabelled."""
    fit = _labelled(p, labels).groupBy(*labels).agg(F.count("*").alias("_n"), F.var_samp("x").alias("_v"), F.regr_slope("y", "x").alias("_phi"), F.regr_intercept("y", "x").alias("_c"))
    fit = fit.where((F.col("_n") >= min_hours) & (F.col("_v") > TINY))
    return p.join(fit, labels, "left").withColumn(name, F.col("y") - F.col("_c") - F.col("_phi") * F.col("x")).drop("_n", "_v", "_phi", "_c")


def comparison(p: DataFrame, models: dict[str, list[str]], min_hours: int = 30) -> DataFrame:
    """Per model (name -> labels): params, n, rmse, kurtosis, loglik, aic, bic. Each model is scored on the rows that it fits."""
    out = None
    for name, labels in models.items():
        r = fitted_residuals(p, labels, min_hours).where("eps_cell is not null")
        k = 2 * F.count_distinct(*labels)
        n, var = F.count("*"), F.var_pop("eps_cell")
        loglik = -n / 2 * (F.ln(2 * math.pi * var) + 1)
        row = r.agg(k.alias("params"), n.alias("n"), F.sqrt(F.avg(F.col("eps_cell") ** 2)).alias("rmse"), kurtosis(F.col("eps_cell")).alias("kurtosis"), loglik.alias("loglik"))
        row = row.select(F.lit(name).alias("model"), "*", (2 * F.col("params") - 2 * F.col("loglik")).alias("aic"), (F.col("params") * F.ln("n") - 2 * F.col("loglik")).alias("bic"))
        out = row if out is None else out.union(row)
    return out


def gaussian_bic(df: DataFrame, value: str, models: dict[str, list[str]], base: str) -> DataFrame:
    """Per model: params, loglik, bic of one normal per group; groups of one row or without spread count nothing; n is the number of rows with base >= 0."""
    ok = df.where((F.col(base) >= 0) & F.col(value).isNotNull())
    n = ok.agg(F.count("*").alias("n"))
    out = None
    for name, labels in models.items():
        g = _labelled(ok, labels).groupBy(*labels).agg(F.count("*").alias("m"), F.var_pop(value).alias("v")).where((F.col("m") > 1) & (F.sqrt("v") > TINY))
        row = g.agg((2 * F.count("*")).alias("params"), F.sum(-F.col("m") / 2 * (F.ln(2 * math.pi * F.col("v")) + 1)).alias("loglik"))
        row = row.join(F.broadcast(n)).select(F.lit(name).alias("model"), "params", "loglik", (F.col("params") * F.ln("n") - 2 * F.col("loglik")).alias("bic"))
        out = row if out is None else out.union(row)
    return out


def alpha_cells(windows: DataFrame, e: str = "e", d: str = "d", min_windows: int = 20) -> DataFrame:
    """(e, d, n, alpha, half_life) of cells with enough windows; the half-life is that of the unrounded mean."""
    g = windows.where((F.col(e) >= 0) & (F.col(d) >= 0)).groupBy(e, d).agg(F.count("*").alias("n"), F.avg("alpha").alias("alpha")).where(F.col("n") >= min_windows)
    return g.withColumn("half_life", half_life_of_alpha(F.col("alpha")))


def alpha_range(cells_: DataFrame, windows: DataFrame, e: str = "e") -> DataFrame:
    """Per E: least and greatest cell alpha, and the half-life of the mean alpha over its windows."""
    ends = cells_.groupBy(e).agg(F.count("*").alias("n_cells"), F.min("alpha").alias("alpha_min"), F.max("alpha").alias("alpha_max"))
    mean = windows.where(F.col(e) >= 0).groupBy(e).agg(F.avg("alpha").alias("alpha_mean"))
    return ends.join(mean, e).withColumn("half_life_mean", half_life_of_alpha(F.col("alpha_mean")))


def alpha_means(cells_: DataFrame, e: str = "e") -> DataFrame:
    """Per E: the plain mean of its cells' alpha, and the mean weighted by windows."""
    return cells_.groupBy(e).agg(F.avg("alpha").alias("alpha_plain"), (F.sum(F.col("alpha") * F.col("n")) / F.sum("n")).alias("alpha_weighted"))


def simulation_parameters(hours: DataFrame, labels: list[str], min_hours: int = 30) -> DataFrame:
    """labels, n, phi, c, sigma fitted where both the hour and the hour before are labelled; sigma is of the cell's own residuals."""
    for label in labels:
        hours = lagged(hours, label, 1, f"_before_{label}")
    p = _labelled(_labelled(pairs(hours), labels), [f"_before_{label}" for label in labels])
    r = fitted_residuals(p, labels, min_hours).where("eps_cell is not null")
    return r.groupBy(*labels).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("phi"), F.regr_intercept("y", "x").alias("c"), F.stddev_pop("eps_cell").alias("sigma"))


def moments(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, std, skew, kurt."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), kurtosis(F.col(value)).alias("kurt"))


def kurtosis_winners(empirical: DataFrame, of_e: DataFrame, of_ed: DataFrame, e: str = "e") -> DataFrame:
    """(e, n, kurt_emp, kurt_phi_E, kurt_phi_ED, winner)."""
    j = empirical.join(of_e.select(e, F.col("kurt").alias("kurt_phi_E")), e).join(of_ed.select(e, F.col("kurt").alias("kurt_phi_ED")), e)
    return j.select(e, "n", F.col("kurt").alias("kurt_emp"), "kurt_phi_E", "kurt_phi_ED", winner(F.col("kurt_phi_E") - F.col("kurt"), F.col("kurt_phi_ED") - F.col("kurt")).alias("winner"))
