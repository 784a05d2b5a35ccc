"""Simulated paths. Each path has its own generator, seeded by (seed, path), so results do not depend on partitions.

Parameters by hour travel as one bounded array per series (its hours), paths are rows
of ``spark.range``, and a task keeps power sums only, never paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_parameters(hours: DataFrame, cells: DataFrame, overall: DataFrame, labels: list[str]) -> DataFrame:
    """(idx, phi, c, sigma, group) of each hour: its cell's parameters, or the overall ones; group is the first label or -1."""
    o = overall.select(*[F.col(c).alias(f"_{c}") for c in ("phi", "c", "sigma")])
    j = hours.join(F.broadcast(cells.select(*labels, "phi", "c", "sigma")), labels, "left").join(F.broadcast(o))  # cells are few; overall is one row
    return j.select("idx", *[F.coalesce(c, f"_{c}").alias(c) for c in ("phi", "c", "sigma")], F.coalesce(labels[0], F.lit(-1)).cast("int").alias("group"))


def simulate_moments(spark: SparkSession, parameters: DataFrame, start: float, n_sim: int = 1000, seed: int = 42) -> DataFrame:
    """(sim, group, n, s1, s2, s3, s4): power sums of the steps of simulated p_t = c + phi p_t-1 + sigma e, by the hour's group."""
    p = parameters.orderBy("idx").toPandas()  # one series: its hours
    phi, c, sigma, group = (p[x].to_numpy() for x in ("phi", "c", "sigma", "group"))
    names, at = np.unique(group, return_inverse=True)
    shared = spark.sparkContext.broadcast((phi, c, sigma, names, at))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phi, c, sigma, names, at = shared.value
        for b in batches:
            for i in range(0, len(b), 50):
                sims = b["id"].to_numpy()[i : i + 50]
                noise = np.stack([np.random.default_rng([seed, int(k)]).standard_normal(len(phi)) for k in sims], 1)
                x, sums = np.full(len(sims), start), np.zeros((4, len(names), len(sims)))
                for t in range(1, len(phi)):
                    y = c[t] + phi[t] * x + sigma[t] * noise[t]
                    d = y - x
                    sums[:, at[t]] += d, d**2, d**3, d**4
                    x = y
                n = np.bincount(at[1:], minlength=len(names))
                for g, name in enumerate(names):
                    yield pd.DataFrame({"sim": sims, "group": name, "n": n[g], **{f"s{k + 1}": sums[k, g] for k in range(4)}})

    return spark.range(n_sim).repartition(max(1, min(n_sim // 25, 256))).mapInPandas(run, "sim long, group int, n long, s1 double, s2 double, s3 double, s4 double")


def _from_sums(df: DataFrame) -> DataFrame:
    m = F.col("s1") / F.col("n")
    m2 = F.col("s2") / F.col("n") - m * m
    m3 = F.col("s3") / F.col("n") - 3 * m * F.col("s2") / F.col("n") + 2 * m**3
    m4 = F.col("s4") / F.col("n") - 4 * m * F.col("s3") / F.col("n") + 6 * m * m * F.col("s2") / F.col("n") - 3 * m**4
    return df.withColumns({"mean": m, "std": F.sqrt(m2), "skew": m3 / F.pow(m2, F.lit(1.5)), "kurt": m4 / (m2 * m2)})


def pooled_moments(sums: DataFrame) -> DataFrame:
    """One row: mean, std, skew, kurt of all simulated steps."""
    return _from_sums(sums.agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "s3", "s4")])).select("mean", "std", "skew", "kurt")


def group_kurtosis(sums: DataFrame, min_hours: int = 50, name: str = "e") -> DataFrame:
    """(e, n, kurt): the mean over simulations of each simulation's kurtosis, for groups with enough hours."""
    per = _from_sums(sums.where((F.col("group") >= 0) & (F.col("n") >= min_hours)))
    return per.groupBy(F.col("group").alias(name)).agg(F.max("n").alias("n"), F.avg("kurt").alias("kurt"))


def ar1_paths(spark: SparkSession, n_sim: int, hours: int, alpha: float, sigma: float, mu: float = 0.0, start_spread: float = 0.0, seed: int = 42) -> DataFrame:
    """(sim, values): x_t = x_t-1 + alpha (mu - x_t-1) + sigma e, from mu or a random start around it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["id"]:
                g = np.random.default_rng([seed, int(k)])
                x, out = mu + start_spread * g.standard_normal(), []
                for e in g.standard_normal(hours):
                    x = x + alpha * (mu - x) + sigma * e
                    out.append(x)
                rows.append(out)
            yield pd.DataFrame({"sim": b["id"], "values": rows})

    return spark.range(n_sim).mapInPandas(run, "sim long, values array<double>")


def garch_fit(r: np.ndarray, rounds: int = 400) -> dict[str, float]:
    """Maximum likelihood of an AR(1) mean with GARCH(1,1) and Student-t noise, by Nelder and Mead's simplex."""
    import math

    y, x = r[1:], r[:-1]
    var0 = float(np.var(r)) or 1.0

    def unpack(v: np.ndarray) -> tuple[float, ...]:
        a, b = 1 / (1 + math.exp(-v[3])), 1 / (1 + math.exp(-v[4]))
        return v[0], math.tanh(v[1]), math.exp(v[2]), a * 0.999 * (1 - b), 0.999 * b, 2.05 + math.exp(min(v[5], 6))

    def loss(v: np.ndarray) -> float:
        mu, phi, omega, a, b, nu = unpack(np.clip(v, -30, 30))
        e2 = (y - mu - phi * x) ** 2
        s, total = var0, 0.0
        scale = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        for z in e2:
            total += 0.5 * math.log(s) + (nu + 1) / 2 * math.log1p(z / (s * (nu - 2)))
            s = omega + a * z + b * s
        return total - len(e2) * scale

    at = np.array([float(np.mean(r)), 0.1, math.log(var0 * 0.05), 0.0, 2.0, 1.0])
    points = [at] + [at + np.eye(6)[i] * 0.5 for i in range(6)]
    values = [loss(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-7:
            break
        centre = np.mean(points[:-1], 0)
        tried = centre + (centre - points[-1])
        v = loss(tried)
        if v < values[0]:
            far = centre + 2 * (centre - points[-1])
            vf = loss(far)
            tried, v = (far, vf) if vf < v else (tried, v)
        elif v >= values[-2]:
            tried = centre + 0.5 * ((tried if v < values[-1] else points[-1]) - centre)
            v = loss(tried)
        if v < values[-1]:
            points[-1], values[-1] = tried, v
        else:
            points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
            values = [values[0]] + [loss(p) for p in points[1:]]
    mu, phi, omega, a, b, nu = unpack(points[int(np.argmin(values))])
    return {"mu": mu, "phi": phi, "omega": omega, "alpha": a, "beta": b, "nu": nu, "loglik": -min(values)}


def garch(series: DataFrame, column: str = "dr", scale: float = 100.0, key: str = "series_id") -> DataFrame:
    """Per series: mu, phi, omega, alpha, beta, nu, loglik fitted on scale * column, and ``vol``: the conditional deviation by idx."""
    keyed = series if key in series.columns else series.withColumn(key, F.lit(0))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        r = scale * pdf[column].to_numpy(float)
        fit = garch_fit(r)
        s, vol = float(np.var(r)) or 1.0, [None]
        for y, x in zip(r[1:], r[:-1], strict=True):
            vol.append(float(np.sqrt(s)))
            s = fit["omega"] + fit["alpha"] * (y - fit["mu"] - fit["phi"] * x) ** 2 + fit["beta"] * s
        return pd.DataFrame([{key: pdf[key].iloc[0], **fit, "vol": [{"idx": int(i), "vol": v} for i, v in zip(pdf["idx"], vol, strict=True)]}])

    kind = dict(keyed.dtypes)[key]
    return keyed.select(key, "idx", column).groupBy(key).applyInPandas(one, f"{key} {kind}, mu double, phi double, omega double, alpha double, beta double, nu double, loglik double, vol array<struct<idx:long,vol:double>>")


def garch_paths(spark: SparkSession, fit: dict[str, float], n_sim: int, hours: int, scale: float = 100.0, seed: int = 42) -> DataFrame:
    """(sim, values): cumulated and centred paths of the fitted model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["id"]:
                g = np.random.default_rng([seed, int(k)])
                z = g.standard_t(fit["nu"], hours) * np.sqrt((fit["nu"] - 2) / fit["nu"])
                s, x, out = fit["omega"] / max(1e-9, 1 - fit["alpha"] - fit["beta"]), fit["mu"], []
                for e in z:
                    shock = np.sqrt(s) * e
                    x = fit["mu"] + fit["phi"] * x + shock
                    s = fit["omega"] + fit["alpha"] * shock**2 + fit["beta"] * s
                    out.append(x / scale)
                path = np.cumsum(out)
                rows.append((path - path.mean()).tolist())
            yield pd.DataFrame({"sim": b["id"], "values": rows})

    return spark.range(n_sim).mapInPandas(run, "sim long, values array<double>")
