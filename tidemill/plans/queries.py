"""The registered queries of the regime analysis, over the whole test tables, with DuckDB SQL where SQL expresses them.

The hourly series is made of ``events``; regimes e and d of windows are quartiles
of mean price and thirds of acf(6), so both engines see the same partition.
Doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalar
from ..operators import decompose, embed, merge, modes, regime_models, regimes, series, simulate, spectral, windows
from ..sources import date_axis
from . import regime_analysis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (BASE if base else "") + sql
        return f

    return add


BASE = """
WITH h AS (SELECT date_trunc('hour', ts) AS datetime, avg(value) AS lmp FROM events GROUP BY 1),
s AS (SELECT datetime, lmp, asinh(lmp) AS y, row_number() OVER (ORDER BY datetime) - 1 AS i FROM h),
b AS (SELECT datetime, lmp, y AS r, y - y0 AS dr, i - 1 AS idx FROM (SELECT *, lag(y) OVER (ORDER BY i) AS y0 FROM s) WHERE i > 0),
k AS (SELECT unnest(range(0, CASE WHEN n < 512 THEN 0 ELSE (n - 512) // 6 + 1 END)) AS window_id FROM (SELECT count(*) AS n FROM b)),
w AS (SELECT window_id, idx - 6 * window_id AS pos, datetime, r::FLOAT::DOUBLE AS r, dr::FLOAT::DOUBLE AS dr, lmp::FLOAT::DOUBLE AS lmp FROM k JOIN b ON idx BETWEEN 6 * window_id AND 6 * window_id + 511),
wm AS (SELECT *, r - avg(r) OVER (PARTITION BY window_id) AS x FROM w),
wl AS (SELECT *, lag(x, 1) OVER p AS x1, lag(x, 6) OVER p AS x6, lag(x, 24) OVER p AS x24, lag(x, 168) OVER p AS x168, r - lag(r) OVER p AS step, dr - lag(dr) OVER p AS ddr FROM wm WINDOW p AS (PARTITION BY window_id ORDER BY pos)),
a AS (SELECT window_id, max(datetime) AS datetime, avg(lmp) AS lmp_mean, coalesce(sum(x * x1), 0) / sum(x * x) AS acf_1h, coalesce(sum(x * x6), 0) / sum(x * x) AS acf_6h, coalesce(sum(x * x24), 0) / sum(x * x) AS acf_24h, coalesce(sum(x * x168), 0) / sum(x * x) AS acf_168h, stddev_pop(step) AS sigma, stddev_pop(r) AS sigma_r, max(abs(r)) AS peak FROM wl GROUP BY 1),
l AS (SELECT *, 1 - acf_1h AS alpha, ntile(4) OVER (ORDER BY lmp_mean, window_id) - 1 AS e, ntile(3) OVER (ORDER BY acf_6h, window_id) - 1 AS d FROM a),
hr AS (SELECT b.idx, b.datetime, b.lmp, l.window_id, l.e, l.d FROM b CROSS JOIN (SELECT max(window_id) AS m FROM l) LEFT JOIN l ON l.window_id = least(b.idx // 6, m)),
p AS (SELECT * FROM (SELECT idx, e, d, lmp AS y, lag(lmp) OVER (ORDER BY idx) AS x, lmp - lag(lmp) OVER (ORDER BY idx) AS dp, lag(e) OVER (ORDER BY idx) AS e0, lag(d) OVER (ORDER BY idx) AS d0 FROM hr) WHERE x IS NOT NULL),
g AS (SELECT count(*) AS n, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM p),
pe AS (SELECT p.*, y - g.c - g.phi * x AS eps FROM p, g)
"""


def hourly_series(spark: SparkSession, sf: str) -> DataFrame:
    return series.hourly(table(spark, sf, "events"))


def branches(spark: SparkSession, sf: str) -> DataFrame:
    return series.branches(series.indexed(hourly_series(spark, sf)))


def windowed(spark: SparkSession, sf: str) -> DataFrame:
    return windows.windows(branches(spark, sf))


def described(spark: SparkSession, sf: str) -> DataFrame:
    """window_id, datetime, lmp_mean, acf_*, alpha, sigma, sigma_r, peak, e, d."""
    w = windowed(spark, sf)
    t = windows.targets(w).drop("acf_6h").join(windows.acf_of(w), "window_id").join(windows.dynamics(w), "window_id")
    one = Window.partitionBy(F.lit(0))  # over one row per window
    return t.withColumns({"e": F.ntile(4).over(one.orderBy("lmp_mean", "window_id")) - 1, "d": F.ntile(3).over(one.orderBy("acf_6h", "window_id")) - 1})


def labelled_hours(spark: SparkSession, sf: str) -> DataFrame:
    return series.labels_by_hour(branches(spark, sf), described(spark, sf).select("window_id", "e", "d"))


def price_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return regime_models.pairs(labelled_hours(spark, sf))


@query("SELECT datetime, round(lmp, 6) AS lmp FROM h")
def series_hourly(spark, sf):
    return rounded(hourly_series(spark, sf))


@query("SELECT idx::BIGINT AS idx, datetime, round(lmp, 6) AS lmp, round(r, 6) AS r, round(dr, 6) AS dr FROM b")
def series_asinh_diff(spark, sf):
    return rounded(branches(spark, sf)).select("idx", "datetime", "lmp", "r", "dr")


@query("SELECT window_id::BIGINT AS window_id, count(*)::BIGINT AS n, min(datetime) AS first, max(datetime) AS last FROM w GROUP BY 1")
def window_bounds(spark, sf):
    return rounded(windowed(spark, sf).groupBy("window_id").agg(F.count("*").alias("n"), F.min("datetime").alias("first"), F.max("datetime").alias("last")))


@query("""SELECT window_id::BIGINT AS window_id, max(datetime) AS datetime, round(avg(dr), 6) AS mean, round(stddev_pop(dr), 6) AS std,
round((avg(dr*dr*dr) - 3*avg(dr)*avg(dr*dr) + 2*pow(avg(dr),3)) / pow(var_pop(dr), 1.5), 6) AS skew, round(kurtosis_pop(dr) + 3, 6) AS kurt,
round(min(dr), 6) AS min, round(max(dr), 6) AS max, round(max(dr) - min(dr), 6) AS range, round(quantile_cont(dr, 0.5), 6) AS median, round(quantile_cont(dr, 0.05), 6) AS p5,
round(quantile_cont(dr, 0.95), 6) AS p95, round(quantile_cont(dr, 0.75) - quantile_cont(dr, 0.25), 6) AS iqr, round(avg(CASE WHEN pos < 504 AND pos % 24 <> 0 THEN abs(ddr) END), 6) AS vol_24h,
round(avg(lmp), 6) AS lmp_mean, round(quantile_cont(lmp, 0.95), 6) AS lmp_p95, round(stddev_pop(lmp), 6) AS lmp_std FROM wl GROUP BY 1""")
def window_features(spark, sf):
    return rounded(windows.features(windowed(spark, sf)))


@query("SELECT window_id::BIGINT AS window_id, round(acf_1h, 6) AS acf_1h, round(acf_6h, 6) AS acf_6h, round(acf_24h, 6) AS acf_24h, round(acf_168h, 6) AS acf_168h FROM a")
def window_acf(spark, sf):
    return rounded(windows.acf_of(windowed(spark, sf)))


@query("SELECT window_id::BIGINT AS window_id, round(alpha, 6) AS alpha, round(sigma, 6) AS sigma, round(sigma_r, 6) AS sigma_r, round(peak, 6) AS peak FROM l")
def window_alpha_sigma(spark, sf):
    return rounded(windows.dynamics(windowed(spark, sf)))


@query("SELECT window_id::BIGINT AS window_id, datetime, round(lmp_mean, 6) AS lmp_mean, round(acf_6h, 6) AS acf_6h FROM a")
def window_targets(spark, sf):
    return rounded(windows.targets(windowed(spark, sf)))


@query(""", m AS (SELECT idx, r - avg(r) OVER () AS x FROM b), q AS (SELECT unnest(range(0, 201)) AS lag)
SELECT lag::BIGINT AS lag, round(sum(u.x * v.x) / (SELECT sum(x * x) FROM m), 6) AS acf FROM q JOIN m u ON TRUE JOIN m v ON v.idx = u.idx + lag GROUP BY 1""")
def acf_series(spark, sf):
    return rounded(series.autocorrelation(branches(spark, sf), "r", 200))


@query("SELECT idx::BIGINT AS idx, datetime, window_id::BIGINT AS window_id, e::BIGINT AS e, d::BIGINT AS d FROM hr")
def hour_regime_map(spark, sf):
    return rounded(labelled_hours(spark, sf).select("idx", "datetime", "window_id", "e", "d"))


@query("SELECT l.datetime, e::BIGINT AS cluster_e, d::BIGINT AS cluster_d, round(b.lmp, 6) AS lmp, round(acf_6h, 6) AS acf_6h FROM l JOIN b ON b.datetime = l.datetime")
def label_join(spark, sf):
    t = described(spark, sf)
    a, c = t.select("datetime", F.col("e").alias("cluster_e")), t.select("datetime", F.col("d").alias("cluster_d"))
    return rounded(a.join(c, "datetime").join(branches(spark, sf).select("datetime", "lmp"), "datetime").join(t.select("datetime", "acf_6h"), "datetime"))


ETA = "SELECT round(sum(n * pow(m - gm, 2)) / (sum(n * pow(m - gm, 2)) + sum(v)), 6) AS eta2 FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS gm FROM ({})) "


@query(ETA.format("SELECT e, count(*) AS n, avg(lmp_mean) AS m, var_pop(lmp_mean) * count(*) AS v FROM l GROUP BY 1"))
def eta_squared(spark, sf):
    return rounded(regimes.eta_squared(described(spark, sf), "lmp_mean", ["e"]))


@query(ETA.format("SELECT e, d, count(*) AS n, avg(alpha) AS m, var_pop(alpha) * count(*) AS v FROM l GROUP BY 1, 2"))
def eta_squared_joint(spark, sf):
    return rounded(regimes.eta_squared(described(spark, sf), "alpha", ["e", "d"]))


@query(ETA.format("SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS v FROM lineitem GROUP BY 1, 2"), base=False)
def eta_squared_lineitem(spark, sf):
    t = table(spark, sf, "lineitem").select("l_extendedprice", F.ascii("l_returnflag").alias("a"), F.ascii("l_linestatus").alias("b"))
    return rounded(regimes.eta_squared(t, "l_extendedprice", ["a", "b"]))


@query(""", c AS (SELECT e, d, count(*) AS n FROM l GROUP BY 1, 2), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY e)) AS i,
(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY d)) AS j, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t) SELECT round((ij - i * j / t) / ((i + j) / 2 - i * j / t), 6) AS ari FROM x""")
def adjusted_rand(spark, sf):
    return rounded(regimes.adjusted_rand(described(spark, sf), "e", "d"))


@query("SELECT e::BIGINT AS e, count(*) FILTER (d = 0)::BIGINT AS d0, count(*) FILTER (d = 1)::BIGINT AS d1, count(*) FILTER (d = 2)::BIGINT AS d2 FROM l GROUP BY 1")
def contingency_grid(spark, sf):
    return rounded(regimes.contingency(described(spark, sf), "e", "d", [0, 1, 2]))


@query("SELECT e::BIGINT AS e, d::BIGINT AS d, count(*)::BIGINT AS n FROM l GROUP BY 1, 2")
def populated_cells(spark, sf):
    return rounded(regimes.populated_cells(described(spark, sf), "e", "d"))


@query("SELECT 'E' || e::INT AS regime, count(*)::BIGINT AS n, round(avg(lmp_mean), 6) AS lmp_mean_mean, round(stddev_pop(lmp_mean), 6) AS lmp_mean_std, round(avg(alpha), 6) AS alpha_mean, round(stddev_pop(alpha), 6) AS alpha_std, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l GROUP BY e")
def regime_summary(spark, sf):
    t = regimes.summary(described(spark, sf), "e", ["lmp_mean", "alpha"])
    return rounded(t.select(F.concat(F.lit("E"), "e").alias("regime"), "n", "lmp_mean_mean", "lmp_mean_std", "alpha_mean", "alpha_std", "share"))


@query("SELECT d::BIGINT AS d, count(*)::BIGINT AS n, round(avg(lmp_mean), 6) AS mean, (row_number() OVER (ORDER BY avg(lmp_mean), d) - 1)::BIGINT AS rank FROM l GROUP BY d")
def regime_rank(spark, sf):
    return rounded(regimes.ranks(described(spark, sf), "d", "lmp_mean"))


@query("SELECT window_id::BIGINT AS window_id, (3 * e + 2)::BIGINT AS label, (dense_rank() OVER (ORDER BY e) - 1)::BIGINT AS dense FROM l")
def relabel_consecutive(spark, sf):
    return rounded(regimes.relabel(described(spark, sf).select("window_id", (3 * F.col("e") + 2).alias("label")), "label", "dense").select("window_id", "label", "dense"))


@query(""", q AS (SELECT e, count(*) AS n, quantile_cont(alpha, 0.25) AS q1, quantile_cont(alpha, 0.5) AS med, quantile_cont(alpha, 0.75) AS q3 FROM l GROUP BY 1)
SELECT q.e::BIGINT AS e, any_value(n)::BIGINT AS n, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3,
round(min(alpha) FILTER (alpha BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(alpha) FILTER (alpha BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
count(*) FILTER (NOT alpha BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::BIGINT AS fliers FROM l JOIN q ON q.e = l.e GROUP BY q.e""")
def regime_boxplot(spark, sf):
    return rounded(regimes.box(described(spark, sf), "e", "alpha"))


@query(", m AS (SELECT quantile_cont(lmp_mean, 0.5) AS mx, quantile_cont(acf_6h, 0.5) AS my FROM l) SELECT lmp_mean >= mx AS high_x, acf_6h >= my AS high_y, count(*)::BIGINT AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM l, m GROUP BY 1, 2")
def quadrants(spark, sf):
    return rounded(regimes.quadrants(described(spark, sf), "lmp_mean", "acf_6h"))


@query("WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(99, floor((l_extendedprice - lo) / (hi - lo) * 100))::BIGINT AS bin, count(*)::BIGINT AS n FROM lineitem, m GROUP BY 1", base=False)
def histogram_100(spark, sf):
    return rounded(regimes.histogram(table(spark, sf, "lineitem"), "l_extendedprice"))


AR1 = "round(-ln(2) / ln(abs({0})), 6)"


@query("SELECT g.n::BIGINT AS n, round(g.phi, 6) AS phi, round(g.c, 6) AS c, round(stddev_pop(dp), 6) AS sig_dp, round(stddev_pop(eps), 6) AS sig_eps, round(kurtosis_pop(eps) + 3, 6) AS kurt, CASE WHEN abs(g.phi) < 1 THEN round(-ln(2) / ln(abs(g.phi)), 6) ELSE 'inf'::DOUBLE END AS half_life FROM pe, g GROUP BY g.n, g.phi, g.c")
def ar1_global(spark, sf):
    return rounded(regime_models.global_summary(price_pairs(spark, sf)))


CELLS = "SELECT {0}, count(*)::BIGINT AS n, round(regr_slope(y, x), 6) AS phi, round(stddev_pop(dp), 6) AS sig_dp, round(stddev_pop(eps), 6) AS sig_eps, round(kurtosis_pop(eps) + 3, 6) AS kurt, CASE WHEN regr_slope(y, x) <> 0 AND abs(regr_slope(y, x)) < 1 THEN round(-ln(2) / ln(abs(regr_slope(y, x))), 6) ELSE 9999.0 END AS half_life FROM pe GROUP BY {1} HAVING count(*) >= 30"


@query(CELLS.format("e::BIGINT AS e", "e"))
def ar1_by_e(spark, sf):
    return rounded(regime_models.cells(price_pairs(spark, sf), ["e"]))


@query(CELLS.format("e::BIGINT AS e, d::BIGINT AS d", "e, d"))
def ar1_by_ed(spark, sf):
    return rounded(regime_models.cells(price_pairs(spark, sf), ["e", "d"]))


@query(""", fe AS (SELECT e, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM p GROUP BY 1 HAVING count(*) >= 30), fd AS (SELECT e, d, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM p GROUP BY 1, 2 HAVING count(*) >= 30),
r AS (SELECT 'phi_E' AS model, 2 * (SELECT count(*) FROM fe) AS params, y - c - phi * x AS z FROM p JOIN fe USING (e) UNION ALL SELECT 'phi_ED', 2 * (SELECT count(*) FROM fd), y - fd.c - fd.phi * x FROM p JOIN fd USING (e, d)),
m AS (SELECT model, params, count(*) AS n, sqrt(avg(z * z)) AS rmse, kurtosis_pop(z) + 3 AS kurtosis, -count(*) / 2.0 * (ln(2 * pi() * var_pop(z)) + 1) AS loglik FROM r GROUP BY 1, 2)
SELECT model, params::BIGINT AS params, n::BIGINT AS n, round(rmse, 6) AS rmse, round(kurtosis, 6) AS kurtosis, round(loglik, 6) AS loglik, round(2 * params - 2 * loglik, 6) AS aic, round(params * ln(n) - 2 * loglik, 6) AS bic FROM m""")
def ar1_model_comparison(spark, sf):
    return rounded(regime_models.comparison(price_pairs(spark, sf), {"phi_E": ["e"], "phi_ED": ["e", "d"]}))


@query(""", c AS (SELECT 'E' AS model, count(*) AS m, var_pop(alpha) AS v FROM l GROUP BY e UNION ALL SELECT 'ED', count(*), var_pop(alpha) FROM l GROUP BY e, d),
s1 AS (SELECT model, 2 * count(*) AS params, sum(-m / 2.0 * (ln(2 * pi() * v) + 1)) AS loglik FROM c WHERE m > 1 AND sqrt(v) > 1e-15 GROUP BY 1)
SELECT model, params::BIGINT AS params, round(loglik, 6) AS loglik, round(params * ln((SELECT count(*) FROM l)) - 2 * loglik, 6) AS bic FROM s1""")
def bic_gaussian(spark, sf):
    return rounded(regime_models.gaussian_bic(described(spark, sf), "alpha", {"E": ["e"], "ED": ["e", "d"]}, "e"))


@query(", f AS (SELECT e, count(*) AS n, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM p WHERE e0 >= 0 GROUP BY 1 HAVING count(*) >= 30) SELECT f.e::BIGINT AS e, any_value(n)::BIGINT AS n, round(any_value(phi), 6) AS phi, round(any_value(c), 6) AS c, round(stddev_pop(y - c - phi * x), 6) AS sigma FROM p JOIN f ON f.e = p.e WHERE e0 >= 0 GROUP BY f.e")
def mc_parameters(spark, sf):
    return rounded(regime_models.simulation_parameters(labelled_hours(spark, sf), ["e"]))


@query("SELECT round(avg(dp), 6) AS mean, round(stddev_pop(dp), 6) AS std, round((avg(dp*dp*dp) - 3*avg(dp)*avg(dp*dp) + 2*pow(avg(dp),3)) / pow(var_pop(dp), 1.5), 6) AS skew, round(kurtosis_pop(dp) + 3, 6) AS kurt FROM p")
def step_moments(spark, sf):
    return rounded(regime_models.moments(price_pairs(spark, sf), "dp"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings", base=False)
def embedding_norm(spark, sf):
    return rounded(table(spark, sf, "embeddings").select("vec_id", scalar.norm(F.col("embedding")).alias("norm")))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice FROM lineitem", base=False)
def standardize(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(spectral.standardize(t, ["l_quantity", "l_extendedprice"]))


DIST = "WITH v AS (SELECT vec_id, embedding, label FROM embeddings), d AS (SELECT a.vec_id AS i, b.vec_id AS j, b.label AS lj, a.label AS li, sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE, 2)))) AS dist FROM v a, v b) "


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


@query(DIST + ", p AS (SELECT dist FROM d WHERE i < j AND dist > 0) SELECT count(*)::BIGINT AS n, round(min(dist), 6) AS least, round(max(dist), 6) AS most, round(pow(quantile_disc(dist, 0.5), 2), 6) AS eps FROM p", base=False)
def pair_distance_stats(spark, sf):
    return rounded(spectral.pair_summary(_vectors(spark, sf), "vec_id", "embedding"))


@query(DIST + ", e AS (SELECT pow(quantile_disc(dist, 0.5), 2) AS eps FROM d WHERE i < j AND dist > 0), k AS (SELECT i, exp(-dist * dist / eps) AS k FROM d, e) SELECT i, round(sum(k), 6) AS degree, round(max(k), 6) AS diagonal FROM k GROUP BY 1", base=False)
def kernel_degrees(spark, sf):
    v = _vectors(spark, sf)
    eps = spectral.pair_summary(v, "vec_id", "embedding").first()["eps"]
    return rounded(spectral.kernel_degrees(v, "vec_id", "embedding", eps or 1.0))


@query(DIST + "SELECT i, j, round(dist, 6) AS dist, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM d WHERE i <> j) WHERE rank <= 5", base=False)
def knn_edges(spark, sf):
    return rounded(spectral.neighbours(_vectors(spark, sf), "vec_id", "embedding", 5).select("i", "j", "dist", "rank"))


@query(DIST + ", s AS (SELECT i, li, lj, count(*) AS n, sum(dist) AS t FROM d GROUP BY 1, 2, 3), x AS (SELECT i, max(CASE WHEN li = lj AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN li <> lj THEN t / n END) AS b FROM s GROUP BY 1) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM x", base=False)
def silhouette_euclidean(spark, sf):
    return rounded(spectral.silhouette(_vectors(spark, sf), "vec_id", "embedding", "label"))


@query(", t AS (SELECT quantile_cont(sigma_r, 0.5) AS s0, quantile_cont(peak, 0.5) AS p0 FROM l) SELECT window_id::BIGINT AS window_id, round(abs(sigma_r - s0) / (s0 + 1e-9) + abs(peak - p0) / (p0 + 1e-9), 6) AS score FROM l, t ORDER BY abs(sigma_r - s0) / (s0 + 1e-9) + abs(peak - p0) / (p0 + 1e-9), window_id LIMIT 5")
def top_similar_windows(spark, sf):
    """A top-k report: the five windows nearest to the median spread and peak."""
    t = described(spark, sf)
    m = t.agg(F.percentile("sigma_r", F.lit(0.5)).alias("s0"), F.percentile("peak", F.lit(0.5)).alias("p0"))
    j = t.join(F.broadcast(m))
    return rounded(windows.nearest(j, scalar.relative_distance(F.col("sigma_r"), F.col("s0"), F.col("peak"), F.col("p0"))).select("window_id", "score"))


@query("SELECT window_id::BIGINT AS window_id, round(sigma_r * sqrt(2 * alpha - alpha * alpha), 6) AS shock FROM l")
def calibrated_shocks(spark, sf):
    return rounded(described(spark, sf).select("window_id", scalar.calibrated_shock(F.col("sigma_r"), F.col("alpha")).alias("shock")))


#: The normal distribution by Simpson's rule over 1,000 steps; Kolmogorov's p-value by its first 100 terms.
NORMAL = "0.5 + z / 3000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1001), lambda k: CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-z * z * k * k / 2000000)))"
KS = f"""
, cs AS (SELECT CELL, stddev_pop(eps) AS s, count(*) AS n FROM pe WHERE e >= 0 AND d >= 0 GROUP BY ALL),
oz AS (SELECT CELL, n, eps / s AS z, row_number() OVER (PARTITION BY CELL ORDER BY eps) AS i FROM pe JOIN cs USING (CELL)),
oc AS (SELECT CELL, n, i, {NORMAL} AS c FROM oz),
ks AS (SELECT CELL, max(n) AS n, max(greatest(i / n - c, c - (i - 1) / n)) AS "KS" FROM oc GROUP BY CELL),
kp AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * "KS" AS t FROM ks),
kt AS (SELECT CELL, n, "KS", CASE WHEN t < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * t * t))))) END AS "KS_p" FROM kp)
"""


def ks_sql(cell: str, text: str) -> str:
    return KS.replace("CELL", cell) + text


@query(ks_sql("e, d", f"""SELECT c.*, round("KS", 6) AS "KS", round("KS_p", 6) AS "KS_p" FROM ({CELLS.format("e::BIGINT AS e, d::BIGINT AS d", "e, d")}) c JOIN kt USING (e, d)"""))
def ar1_table_with_ks(spark, sf):
    return rounded(regime_models.cell_table(price_pairs(spark, sf), ["e", "d"]))


# What SQL does not express: checked by rows here, by value in tests.


@query()
def kurtosis_cascade(spark, sf):
    p = price_pairs(spark, sf)
    return rounded(regime_models.cascade(regime_models.cell_table(p, ["e"]), regime_models.cell_table(p, ["e", "d"]), regime_models.global_summary(p)))


@query()
def mstl_components(spark, sf):
    return decompose.decompose(series.indexed(hourly_series(spark, sf)), "y", (24, 168))


@query()
def window_embeddings(spark, sf):
    return embed.embed(windows.as_arrays(windowed(spark, sf)))


@query()
def diffusion_coords(spark, sf):
    x = spectral.principal_components(spectral.standardize_vectors(_vectors(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))))
    return spectral.diffusion_coordinates(x, "vec_id")[0]


@query()
def spectral_gaps(spark, sf):
    x = spectral.standardize_vectors(_vectors(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("x")))
    return spectral.eigenvalue_ratios(spark, spectral.diffusion_coordinates(x, "vec_id")[1])


@query()
def dimension_sweep(spark, sf):
    x = spectral.standardize_vectors(_vectors(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("x")))
    coords, values = spectral.diffusion_coordinates(x, "vec_id", "x", Config().eigenpairs)
    return spectral.choose_dimension(coords, "vec_id", range(2, min(21, len(values) + 1)), seeds=5)


@query()
def tomato_modes(spark, sf):
    x = spectral.standardize_vectors(_vectors(spark, sf).select(F.col("vec_id").alias("window_id"), F.col("embedding").cast("array<double>").alias("x")))
    coords, values = spectral.diffusion_coordinates(x, "window_id", "x", Config().eigenpairs)
    labels, k, n = regime_analysis.partition(coords, max(1, len(values)), Config())
    return labels.select(F.col("i").alias("vec_id"), "label", F.lit(k).alias("k"), F.lit(n).alias("n_modes"))


@query()
def tukey_merge(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_quantity").cast("int")).alias("label"), F.col("l_extendedprice").alias("target"))
    return merge.tukey_merge(t, "label", "target").groupBy("label", "merged").agg(F.count("*").alias("n"))


@query()
def mc_moments(spark, sf):
    p = price_pairs(spark, sf)
    overall = regime_models.global_summary(p).select("phi", "c", F.col("sig_eps").alias("sigma"))
    hours = labelled_hours(spark, sf)
    par = simulate.hourly_parameters(hours, regime_models.simulation_parameters(hours, ["e"]), overall, ["e"])
    first = branches(spark, sf).orderBy("idx").select("lmp").first()
    return simulate.pooled_moments(simulate.simulate_moments(spark, par, first[0] if first else 1.0, Config().n_sim))


@query()
def garch_parameters(spark, sf):
    return simulate.garch(branches(spark, sf)).drop("vol")


@query()
def ar1_paths(spark, sf):
    return simulate.ar1_paths(spark, 20, 512, 0.1, 1.0)
