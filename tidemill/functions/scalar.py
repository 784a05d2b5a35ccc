"""Column expressions. Moments are population moments; kurtosis is Pearson's (3 for a normal)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-15


def f32(x: Column) -> Column:
    """Rounded to single precision, as a double."""
    return x.cast("float").cast("double")


def half_life(phi: Column, undefined: float = math.inf, positive: bool = False) -> Column:
    """-ln 2 / ln |phi| where |phi| < 1 (and over 0, if ``positive``), else ``undefined``."""
    a = F.abs(phi)
    ok = (a < 1) & (a > 0) if positive else a < 1
    return F.when(ok, -math.log(2) / F.ln(F.when(a > 0, a))).otherwise(F.when(phi.isNotNull(), F.lit(float(undefined))))


def half_life_of_alpha(alpha: Column) -> Column:
    """-ln 2 / ln(1 - alpha) where alpha < 1, else infinite."""
    return F.when(alpha < 1, -math.log(2) / F.ln(1 - alpha)).otherwise(F.lit(math.inf))


def kurtosis(x: Column) -> Column:
    return F.kurtosis(x) + 3


def winner(error_e: Column, error_ed: Column) -> Column:
    """Which model has the smaller absolute error."""
    return F.when(F.abs(error_ed) < F.abs(error_e), "ED").when(F.abs(error_e) < F.abs(error_ed), "E").otherwise("tie")


def norm(v: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def feature_group(name: Column) -> Column:
    """economic, dynamic or distribution, by the feature's name."""
    return F.when(name.isin("lmp_mean", "lmp_p95", "lmp_std"), "economic").when(name.startswith("acf_"), "dynamic").otherwise("distribution")


def calibrated_shock(std: Column, alpha: Column) -> Column:
    """The shock size that gives an AR(1) path with pull alpha the standard deviation std."""
    return std * F.sqrt(2 * alpha - alpha * alpha)


def relative_distance(std: Column, std0: Column, peak: Column, peak0: Column) -> Column:
    return F.abs(std - std0) / (std0 + 1e-9) + F.abs(peak - peak0) / (peak0 + 1e-9)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by its series (|x| <= 5) and continued fraction, to about 1e-12, JVM-side."""
    a = F.abs(x)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    steps = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: k.cast("double"))
    series = F.aggregate(steps, F.struct(a.alias("term"), a.alias("total")), lambda s, k: F.struct((s["term"] * a * a / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * a * a / (2 * k + 1)).alias("total")))["total"]
    fraction = F.aggregate(F.reverse(steps), F.lit(0.0), lambda s, k: k / (a + s))
    upper = F.when(a <= 5, 0.5 + density * series).otherwise(1 - density / (a + fraction))
    return F.when(x >= 0, upper).otherwise(1 - upper)
