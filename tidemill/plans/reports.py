"""Queries over the series of all event types, and the tables behind the reports.

Each ``event_type`` is a series with windows of its own, so that there are windows enough for the filters of 20 windows, 30 and 50
hours. Regimes e and d are thirds of all windows by mean price and halves by acf(6), so both engines see the same
partition. Doubles are rounded to six places.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalar
from ..operators import knn, ordered, regime_models, regimes, series, spectral, windows
from ..sources import Scratch, date_axis
from . import queries as base
from . import regime_analysis
from .queries import ks_sql, query, rounded, table

FEATURES = [*Config().features]
ACF = [f"acf_{k}h" for k in Config().acf_lags]

KEYED = """
WITH h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS datetime, avg(value) AS lmp FROM events GROUP BY 1, 2),
s AS (SELECT *, asinh(lmp) AS y, row_number() OVER (PARTITION BY series_id ORDER BY datetime) - 1 AS i FROM h),
b AS (SELECT series_id, datetime, lmp, y AS r, y - y0 AS dr, i - 1 AS idx FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY i) AS y0 FROM s) WHERE i > 0),
k AS (SELECT series_id, unnest(range(0, CASE WHEN n < 512 THEN 0 ELSE (n - 512) // 6 + 1 END)) AS window_id FROM (SELECT series_id, count(*) AS n FROM b GROUP BY 1)),
w AS (SELECT k.series_id, window_id, idx - 6 * window_id AS pos, datetime, r::FLOAT::DOUBLE AS r, dr::FLOAT::DOUBLE AS dr, lmp::FLOAT::DOUBLE AS lmp FROM k JOIN b ON b.series_id = k.series_id AND idx BETWEEN 6 * window_id AND 6 * window_id + 511),
wm AS (SELECT *, r - avg(r) OVER (PARTITION BY series_id, window_id) AS x FROM w),
wl AS (SELECT *, lag(x, 1) OVER p AS x1, lag(x, 6) OVER p AS x6, lag(x, 24) OVER p AS x24, lag(x, 168) OVER p AS x168, dr - lag(dr) OVER p AS ddr FROM wm WINDOW p AS (PARTITION BY series_id, window_id ORDER BY pos)),
a AS (SELECT series_id, window_id, max(datetime) AS datetime, avg(dr) AS mean, stddev_pop(dr) AS std, (avg(dr*dr*dr) - 3*avg(dr)*avg(dr*dr) + 2*pow(avg(dr),3)) / pow(var_pop(dr), 1.5) AS skew, kurtosis_pop(dr) + 3 AS kurt,
min(dr) AS min, max(dr) AS max, max(dr) - min(dr) AS range, quantile_cont(dr, 0.5) AS median, quantile_cont(dr, 0.05) AS p5, quantile_cont(dr, 0.95) AS p95, quantile_cont(dr, 0.75) - quantile_cont(dr, 0.25) AS iqr,
avg(CASE WHEN pos < 504 AND pos % 24 <> 0 THEN abs(ddr) END) AS vol_24h, avg(lmp) AS lmp_mean, quantile_cont(lmp, 0.95) AS lmp_p95, stddev_pop(lmp) AS lmp_std, coalesce(sum(x * x1), 0) / sum(x * x) AS acf_1h,
coalesce(sum(x * x6), 0) / sum(x * x) AS acf_6h, coalesce(sum(x * x24), 0) / sum(x * x) AS acf_24h, coalesce(sum(x * x168), 0) / sum(x * x) AS acf_168h FROM wl GROUP BY 1, 2),
l AS (SELECT *, 1 - acf_1h AS alpha, ntile(3) OVER (ORDER BY lmp_mean, series_id, window_id) - 1 AS e, ntile(2) OVER (ORDER BY acf_6h, series_id, window_id) - 1 AS d FROM a),
hr AS (SELECT b.series_id, b.idx, b.datetime, b.lmp, l.window_id, l.e, l.d FROM b JOIN (SELECT series_id, max(window_id) AS m FROM l GROUP BY 1) z ON z.series_id = b.series_id LEFT JOIN l ON l.series_id = b.series_id AND l.window_id = least(b.idx // 6, m)),
p AS (SELECT * FROM (SELECT series_id, idx, e, d, lmp AS y, lag(lmp) OVER q AS x, lmp - lag(lmp) OVER q AS dp FROM hr WINDOW q AS (PARTITION BY series_id ORDER BY idx)) WHERE x IS NOT NULL),
g AS (SELECT count(*) AS n, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM p),
pe AS (SELECT p.*, y - g.c - g.phi * x AS eps FROM p, g)
"""


def keyed(sql: str | None = None):
    return query(KEYED + sql if sql else None, base=False)


def keyed_branches(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    return series.branches(series.indexed(series.hourly(events)))


def keyed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """series_id, window_id, datetime, the 15 features, acf_*, alpha, e, d; written, as every report reads it."""
    s = Scratch(spark)
    w = s.save(windows.windows(keyed_branches(spark, sf)))
    by = ["series_id", "window_id"]
    t = s.save(windows.features(w).join(windows.acf_of(w), by).withColumn("alpha", 1 - F.col("acf_1h")))
    return s.save(ordered.groups_of(ordered.groups_of(t, ["lmp_mean", *by], 3, "e"), ["acf_6h", *by], 2, "d"))


def keyed_hours(spark: SparkSession, sf: str) -> DataFrame:
    return series.labels_by_hour(keyed_branches(spark, sf), keyed_windows(spark, sf).select("series_id", "window_id", "e", "d"))


def keyed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return Scratch(spark).save(regime_models.pairs(keyed_hours(spark, sf)))


@keyed("SELECT series_id, window_id::BIGINT AS window_id, e::BIGINT AS e, d::BIGINT AS d, round(alpha, 6) AS alpha, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*FEATURES, *ACF]) + " FROM l")
def keyed_window_table(spark, sf):
    return rounded(keyed_windows(spark, sf).select("series_id", "window_id", "e", "d", "alpha", *FEATURES, *ACF))


def _eta(label: str) -> str:
    return f"""(SELECT feature, sum(n * pow(m - gm, 2)) / (sum(n * pow(m - gm, 2)) + sum(q)) AS x FROM (SELECT *, sum(n * m) OVER z / sum(n) OVER z AS gm FROM (SELECT feature, {label}, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS q FROM f GROUP BY 1, 2) WINDOW z AS (PARTITION BY feature)) GROUP BY 1)"""


@keyed(f""", f AS (SELECT e, d, unnest([{', '.join([*FEATURES, *ACF])}]) AS v, unnest([{', '.join(repr(c) for c in [*FEATURES, *ACF])}]) AS feature FROM l)
SELECT t1.feature, round(t1.x, 3) AS eta2_e, round(t2.x, 3) AS eta2_d, CASE WHEN t1.feature LIKE 'lmp%' THEN 'economic' WHEN t1.feature LIKE 'acf%' THEN 'dynamic' ELSE 'distribution' END AS kind FROM {_eta('e')} t1 JOIN {_eta('d')} t2 ON t1.feature = t2.feature""")
def eta_table(spark, sf):
    """All 19 features of the study."""
    return regimes.eta_table(keyed_windows(spark, sf), [*FEATURES, *ACF], {"eta2_e": "e", "eta2_d": "d"}).withColumn("kind", scalar.feature_group(F.col("feature")))


_PAIRS = [(b, a) for a, b in combinations(FEATURES, 2)]


@keyed(f"SELECT unnest([{', '.join(repr(a) for a, _ in _PAIRS)}]) AS a, unnest([{', '.join(repr(b) for _, b in _PAIRS)}]) AS b, unnest([{', '.join(f'round(corr({a}, {b}), 6)' for a, b in _PAIRS)}]) AS corr FROM l")
def correlation_matrix(spark, sf):
    """The lower triangle of all 15 features."""
    return rounded(regimes.correlations(keyed_windows(spark, sf), FEATURES))


@query("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL)::BIGINT AS {c}" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")) + " FROM events", base=False)
def null_counts(spark, sf):
    return rounded(regimes.null_counts(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")))


@query(", q AS (SELECT min(datetime) AS t0, max(datetime) AS t1 FROM h), z AS (SELECT unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS datetime FROM q) SELECT z.datetime, round(h.lmp, 6) AS lmp FROM z LEFT JOIN h ON h.datetime = z.datetime")
def grid_left_join(spark, sf):
    """From the first to the last hour."""
    h = Scratch(spark).save(base.hourly_series(spark, sf))
    r = h.agg(F.min("datetime").cast("string").alias("t0"), (F.timestamp_diff("HOUR", F.min("datetime"), F.max("datetime")) + 1).alias("n")).first()
    return rounded(series.on_grid(date_axis(spark, r["t0"], r["n"] or 0), h))


@keyed(", rx AS (SELECT rank() OVER (ORDER BY lmp_mean) + (count(*) OVER (PARTITION BY lmp_mean) - 1) / 2.0 AS x, rank() OVER (ORDER BY alpha) + (count(*) OVER (PARTITION BY alpha) - 1) / 2.0 AS y FROM l), o AS (SELECT count(*) AS n, corr(x, y) AS rho FROM rx), t AS (SELECT *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2 AS v FROM o), "
       "i AS (SELECT t.*, atan(t / sqrt(v)) AS lo, unnest(range(0, 20000)) AS j FROM t) SELECT n::BIGINT AS n, round(rho, 6) AS rho, round(sum(pow(cos(lo + (j + 0.5) * (pi() / 2 - lo) / 20000), v - 1)) * any_value(pi() / 2 - lo) / 20000 * 2 * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(pi()), 6) AS p FROM i GROUP BY n, rho, v")  # fmt: skip
def spearman(spark, sf):
    return rounded(regimes.spearman(keyed_windows(spark, sf), "lmp_mean", "alpha"))


@query("SELECT l_returnflag AS flag, count(*)::BIGINT AS n, round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1", base=False)
def group_quantiles(spark, sf):
    """Exact quantiles of three groups of all lines."""
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return rounded(ordered.quantiles(t, "l_extendedprice", {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}, ["flag"]))


@query("SELECT count(l_extendedprice)::BIGINT AS count, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(max(l_extendedprice), 6) AS max FROM lineitem", base=False)
def describe_prices(spark, sf):
    return rounded(regimes.describe(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0)::DOUBLE AS place FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)", base=False)
def tied_ranks(spark, sf):
    """Mean ranks of 50 quantities inside three groups that hold all lines."""
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rounded(ordered.ranked(t, "l_quantity", "place", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "place"))


@keyed("SELECT series_id, idx::BIGINT AS idx, round(sum(r - m) OVER (PARTITION BY series_id ORDER BY idx), 6) AS total FROM (SELECT *, avg(r) OVER (PARTITION BY series_id) AS m FROM b)")
def running_sum_centred(spark, sf):
    b = Scratch(spark).save(keyed_branches(spark, sf))
    x = b.join(b.groupBy("series_id").agg(F.avg("r").alias("m")), "series_id").withColumn("x", F.col("r") - F.col("m"))
    return rounded(ordered.running(x, {"total": ("sum", "x")}, ["series_id"]).select("series_id", "idx", "total"))


@query(KEYED.replace("WITH h AS", "WITH RECURSIVE h AS", 1) + ", z AS (SELECT series_id, idx, 0.1 * lmp AS level FROM b WHERE idx = 0 UNION ALL SELECT b.series_id, b.idx, 0.9 * z.level + 0.1 * b.lmp FROM z JOIN b ON b.series_id = z.series_id AND b.idx = z.idx + 1) SELECT series_id, idx::BIGINT AS idx, round(level, 6) AS level FROM z", base=False)
def ar1_recursion(spark, sf):
    """The first-order recursion x[t] = 0.9 x[t-1] + 0.1 price[t] along each series."""
    b = keyed_branches(spark, sf).withColumns({"a": F.lit(0.9), "u": 0.1 * F.col("lmp")})
    return rounded(ordered.recursion(b, "a", "u", 0.0, "level", ["series_id"]).select("series_id", "idx", "level"))


CELLS = ", c AS (SELECT e, d, count(*) AS n, avg(alpha) AS alpha FROM l GROUP BY 1, 2 HAVING count(*) >= 20) "
LIFE = "CASE WHEN {0} < 1 THEN round(-ln(2) / ln(1 - {0}), 6) ELSE 'inf'::DOUBLE END"


@keyed(CELLS + f"SELECT e::BIGINT AS e, d::BIGINT AS d, n::BIGINT AS n, round(alpha, 6) AS alpha, {LIFE.format('alpha')} AS half_life FROM c")
def alpha_cells(spark, sf):
    return rounded(regime_models.alpha_cells(keyed_windows(spark, sf)))


@keyed(CELLS + f"SELECT c.e::BIGINT AS e, count(*)::BIGINT AS n_cells, round(min(c.alpha), 6) AS alpha_min, round(max(c.alpha), 6) AS alpha_max, round(any_value(m.a), 6) AS alpha_mean, {LIFE.format('any_value(m.a)')} AS half_life_mean FROM c JOIN (SELECT e, avg(alpha) AS a FROM l GROUP BY 1) m ON m.e = c.e GROUP BY c.e")
def alpha_range(spark, sf):
    t = keyed_windows(spark, sf)
    return rounded(regime_models.alpha_range(regime_models.alpha_cells(t), t))


@keyed(CELLS + "SELECT e::BIGINT AS e, round(avg(alpha), 6) AS alpha_plain, round(sum(alpha * n) / sum(n), 6) AS alpha_weighted FROM c GROUP BY 1")
def alpha_means(spark, sf):
    return rounded(regime_models.alpha_means(regime_models.alpha_cells(keyed_windows(spark, sf))))


@keyed(CELLS + ", o AS (SELECT *, row_number() OVER (ORDER BY alpha, d) - 1 AS rn, count(*) OVER () AS m FROM c WHERE e = (SELECT e FROM c GROUP BY 1 ORDER BY count(*) DESC, e LIMIT 1)) SELECT e::BIGINT AS e, d::BIGINT AS d, n::BIGINT AS n, round(alpha, 6) AS alpha, rn::BIGINT AS place FROM o WHERE rn IN (0, m // 2, m - 1)")
def cell_pick(spark, sf):
    """First, middle and last cell by alpha of the regime with most cells of 20 windows or more."""
    t = Scratch(spark).save(regime_models.alpha_cells(keyed_windows(spark, sf)).drop("half_life"))
    most = t.groupBy("e").agg(F.count("*").alias("m")).orderBy(F.col("m").desc(), "e").limit(1).select("e")
    return rounded(regimes.first_middle_last(t.join(F.broadcast(most), "e"), "alpha", "d").select("e", "d", "n", "alpha", "place"))


AR = ", c AS (SELECT e, d, count(*) AS n, regr_slope(y, x) AS phi, stddev_pop(dp) AS sig_dp FROM pe GROUP BY 1, 2 HAVING count(*) >= 30) "


@keyed(AR + "SELECT e::BIGINT AS e, count(*)::BIGINT AS n_cells, round(min(phi), 6) AS phi_min, round(max(phi), 6) AS phi_max, round(min(sig_dp), 6) AS sig_dp_min, round(max(sig_dp), 6) AS sig_dp_max FROM c GROUP BY 1 HAVING count(*) > 1")
def ar1_phi_range(spark, sf):
    return rounded(regime_models.ranges_inside(regime_models.cells(keyed_pairs(spark, sf), ["e", "d"])))


@keyed(AR + ", m AS (SELECT avg(phi) AS gm FROM c), q AS (SELECT d, count(*) AS n, avg(phi) AS m, var_pop(phi) * count(*) AS v FROM c GROUP BY 1), rx AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS x, rank() OVER (ORDER BY phi) AS y FROM c) "
       "SELECT round((SELECT sum(n * pow(q.m - gm, 2)) / (sum(n * pow(q.m - gm, 2)) + sum(v)) FROM q, m), 6) AS eta2, (SELECT count(*) FROM c)::BIGINT AS n, (SELECT round(corr(x, y), 6) FROM rx) AS rho")  # fmt: skip
def phi_by_d(spark, sf):
    """How far d tells the phi of cells apart, each cell counting once, and their rank correlation."""
    cells = Scratch(spark).save(regime_models.cells(keyed_pairs(spark, sf), ["e", "d"]))
    return rounded(regimes.of_cells(cells, "phi", "d").select("eta2", "n", "rho"))


@keyed(""", s2 AS (SELECT e, d, count(*) AS n, var_pop(eps) AS v FROM pe GROUP BY 1, 2), x AS (SELECT e, 3 * sum(n * v * v) * sum(n) / pow(sum(n * v), 2) AS ked FROM s2 GROUP BY 1), r AS (SELECT e, count(*) AS n, kurtosis_pop(eps) + 3 AS kurt FROM pe GROUP BY 1 HAVING count(*) >= 50)
SELECT r.e::BIGINT AS e, n::BIGINT AS n, round(kurt, 6) AS kurt_emp, 3.0::DOUBLE AS kurt_phi_E, round(ked, 6) AS kurt_phi_ED, CASE WHEN abs(ked - kurt) < abs(3 - kurt) THEN 'ED' WHEN abs(3 - kurt) < abs(ked - kurt) THEN 'E' ELSE 'tie' END AS winner FROM r JOIN x ON x.e = r.e""")
def kurtosis_by_e(spark, sf):
    """The kurtosis of residuals by regime against that of two models: one normal for each e, and one for each (e, d)."""
    p = Scratch(spark).save(regime_models.with_residual(keyed_pairs(spark, sf)))
    found = p.groupBy("e").agg(F.count("*").alias("n"), scalar.kurtosis(F.col("eps")).alias("kurt")).where(F.col("n") >= Config().min_kurtosis_hours)
    parts = p.groupBy("e", "d").agg(F.count("*").alias("n"), F.var_pop("eps").alias("v")).groupBy("e")
    mixed = parts.agg((3 * F.sum(F.col("n") * F.col("v") * F.col("v")) * F.sum("n") / F.pow(F.sum(F.col("n") * F.col("v")), F.lit(2.0))).alias("kurt"))
    return rounded(regime_models.kurtosis_winners(found, found.select("e", F.lit(3.0).alias("kurt")), mixed))


def _evidence(label: str, own: str, value: str) -> str:
    inside = "v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return f"""SELECT '{label}' AS partition, '{label.upper()}' || x.{label}::INT AS regime, any_value(place)::BIGINT AS place, '{value}' AS value, count(*)::BIGINT AS n, round(avg(v), 6) AS mean, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
round(min(v) FILTER ({inside}), 6) AS whisker_low, round(max(v) FILTER ({inside}), 6) AS whisker_high FROM (SELECT {label}, {value} AS v FROM l) x JOIN (SELECT {label}, row_number() OVER (ORDER BY avg({own}), {label}) - 1 AS place, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS q2, quantile_cont({value}, 0.75) AS q3 FROM l GROUP BY 1) q ON q.{label} = x.{label} GROUP BY x.{label}"""


_SIDES = [("e", "lmp_mean"), ("d", "acf_6h")]


@keyed(" UNION ALL ".join(_evidence(label, own, value) for label, own in _SIDES for _, value in _SIDES))
def axes_evidence(spark, sf):
    """The boxes of price and persistence by both partitions, with rank, size and mean: the data of the two merge reports and of the evidence for two axes."""
    return rounded(regimes.evidence(keyed_windows(spark, sf), ["e", "d"], ["lmp_mean", "acf_6h"]))


@keyed(CELLS + ", re AS (SELECT e, row_number() OVER (ORDER BY avg(lmp_mean), e) - 1 AS place FROM l GROUP BY 1), rd AS (SELECT d, row_number() OVER (ORDER BY avg(acf_6h), d) - 1 AS place FROM l GROUP BY 1) SELECT re.place::BIGINT AS e_place, rd.place::BIGINT AS d_place, c.e::BIGINT AS e, c.d::BIGINT AS d, n::BIGINT AS n, round(alpha, 6) AS alpha FROM c JOIN re ON re.e = c.e JOIN rd ON rd.d = c.d")
def alpha_heat_map(spark, sf):
    t = keyed_windows(spark, sf)
    return rounded(regimes.heat_map(regime_models.alpha_cells(t), regimes.ranks(t, "e", "lmp_mean"), regimes.ranks(t, "d", "acf_6h"), "alpha"))


@keyed("SELECT 'E' || e::INT AS regime, e::BIGINT AS label, count(*)::BIGINT AS n, round(100 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS percent FROM l GROUP BY e")
def regime_names(spark, sf):
    """Names made of labels, and the labels read back from the names."""
    t = regimes.summary(keyed_windows(spark, sf), "e", []).select(F.concat(F.lit("E"), "e").alias("regime"), "n", F.round(100 * F.col("share"), 1).alias("percent"))
    return rounded(t.withColumn("label", regimes.label_of(F.col("regime"))).select("regime", "label", "n", "percent"))


# What SQL does not express: checked by value in tests.


@query()
def knn_by_index(spark, sf):
    """The five nearest rows of each row by the index."""
    return rounded(knn.search(knn.build(table(spark, sf, "embeddings"), "vec_id", "embedding", 5), 5).select("i", "j", "dist", "rank"))


@query()
def coordinates_and_targets(spark, sf):
    """The first two diffusion coordinates of each window of all series beside the targets that they are coloured by."""
    t = ordered.positions(keyed_windows(spark, sf), ["series_id", "window_id"], name="k")
    x = spectral.standardize(t, FEATURES).select("k", F.array(*FEATURES).alias("x"))
    dc, _ = spectral.diffusion_coordinates(x, "k", "x", 2)
    return rounded(dc.join(t, "k").select("series_id", "window_id", F.get("dc", F.lit(0)).alias("dc1"), F.get("dc", F.lit(1)).alias("dc2"), "lmp_mean", "acf_6h", "e", "d"))


@query()
def regime_run(spark, sf):
    """The whole analysis with its own labels, and its one-row summary."""
    cfg = Config(periods=(24, 168))
    hourly = base.hourly_series(spark, sf)
    return regime_analysis.analyse(spark, regime_analysis.prepare(hourly, cfg), Scratch(spark).root + "/run", cfg=cfg)


def all_queries() -> dict:
    return dict(base.QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(base.ORACLES)


@keyed(ks_sql("e, d", """SELECT e::BIGINT AS e, d::BIGINT AS d, n::BIGINT AS n, round("KS", 6) AS "KS", round("KS_p", 6) AS "KS_p" FROM kt WHERE n >= 30"""))
def keyed_ks_cells(spark, sf):
    return rounded(regime_models.cell_table(keyed_pairs(spark, sf), ["e", "d"]).select("e", "d", "n", "KS", "KS_p"))


@keyed(ks_sql("e", """SELECT e::BIGINT AS e, n::BIGINT AS n, round("KS", 6) AS "KS", round("KS_p", 6) AS "KS_p" FROM kt WHERE n >= 30"""))
def keyed_ks_regimes(spark, sf):
    return rounded(regime_models.cell_table(keyed_pairs(spark, sf), ["e"]).select("e", "n", "KS", "KS_p"))
