"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources share ``budget`` times all words by weight; a target stops at ``cap`` times
its source's words, and the excess is shared again by weight. Inside a source the
target is shared over length tiers in the same way, which gives each document an
expected number of copies: certain whole copies first, then a sample with unequal
inclusion chances for the rest. The sample ranks documents by random odds over
inclusion odds, u/(1-u) / (p/(1-p)) (Rosen 1997), and takes the smallest ranks
until the source's remaining words are met, so its size in words is fixed. Where the
next rank is too long for the words that are still needed, it is skipped, and the ranks after it that fit go
on filling the gap, FILLS times at most: no long document takes a source past its target.

No source is sorted as a whole: ranks fall into ``BINS`` bins that are summed with
map-side aggregation, the bin at the cut is opened again in finer bins, and only
the ranks of the last, narrow bin are ordered. u is a hash of doc_id, text and
seed, so reruns agree.

Nulls: a null text has size 0 and is never taken; a null source is a source of its
own, last in order. Repeated rows share one rank and are taken all or none; where they are too
many for the gap they are skipped. A very long text is one document as any other. Columns beside doc_id, source and text
are not read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, beside, fresh, own, text_key

BINS, ROUNDS, FILLS = 1 << 16, 1, 3
#: Words are whole numbers; a gap is one but for rounding.
EPS = 1e-6
#: Tier -> smallest size in words and weight of its documents' expected copies.
TIERS = [(0, 1.0), (100, 1.25), (1000, 1.5)]


def water_fill(table: DataFrame, keys: list[str], total: str, weight: str, most: str) -> DataFrame:
    """Adds ``share``: ``total`` (equal inside a group) dealt by ``weight``, none above ``most``, the excess dealt again.

    In order of most/weight, the first k rows stay at ``most``, and the others get
    weight times the level (total - sum of those) / (sum of the other weights): k
    is the smallest number whose level no later row exceeds.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(most) / F.col(weight), F.col("_tie"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    t = table.withColumn("_tie", F.xxhash64(*[F.col(c) for c in table.columns]))
    t = t.withColumns({"_used": F.coalesce(F.sum(most).over(before), F.lit(0.0)), "_gone": F.coalesce(F.sum(weight).over(before), F.lit(0.0)), "_all": F.sum(weight).over(whole)})
    t = t.withColumn("_level", (F.col(total) - F.col("_used")) / (F.col("_all") - F.col("_gone")))
    fits = F.when(F.col("_level") * F.col(weight) <= F.col(most), F.struct("_n", "_level"))
    t = t.withColumn("_n", F.row_number().over(order)).withColumn("_final", F.min(fits).over(whole)["_level"])
    return t.withColumn("share", F.least(F.col(most).cast("double"), F.coalesce(F.col("_final") * F.col(weight), F.col(most).cast("double")))).drop("_tie", "_used", "_gone", "_all", "_level", "_n", "_final")


def source_targets(sizes: DataFrame, weights: list[float], budget: float, cap: float) -> DataFrame:
    """source, source_size, target: one row per source."""
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    t = t.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    t = t.withColumns({"all": budget * F.sum("source_size").over(Window.partitionBy(F.lit(0))), "most": cap * F.col("source_size")})
    return water_fill(t, [F.lit(0)], "all", "w", "most").select("source", "source_size", F.col("share").alias("target"))


def _tier(size: Column) -> Column:
    at = F.lit(0)
    for k, (least, _) in enumerate(TIERS[1:], 1):
        at = F.when(size >= least, k).otherwise(at)
    return at


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """doc_id, key (of the text), size, source, source_size, target, expected (copies), copies and taken (words), for each row of docs."""
    s = Scratch(docs.sparkSession)
    n_words = F.length(F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x20\\x09-\\x0D]+", "w"), BLANKS, ""))
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    u = (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    base = s.save(docs.select("doc_id", "source", text_key(F.col("text")).alias("key"), n_words.cast("long").alias("size"), u.alias("u")).withColumn("tier", _tier(F.col("size"))))
    targets = s.save(source_targets(base, list(weights), budget, cap))
    tier_weight = F.get(F.array(*[F.lit(w) for _, w in TIERS]), F.col("tier"))
    tiers = base.groupBy("source", "tier").agg(F.sum("size").cast("double").alias("words")).where("words > 0")
    tiers = same(tiers, targets, "source").withColumns({"w": tier_weight * F.col("words"), "most": cap * F.col("words")})
    tiers = s.save(water_fill(tiers, ["source"], "target", "w", "most").select("source", "tier", "source_size", "target", (F.col("share") / F.col("words")).alias("expected")))
    rows = same(base.where("size > 0"), tiers.drop("source_size", "target"), "source", "tier")
    p = F.col("expected") - F.col("whole")
    rows = rows.withColumn("whole", F.floor("expected")).withColumn("p", p)
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    rows = s.save(rows.withColumn("rank", F.when(F.col("p") > 1e-12, odds / (1 + odds))))
    need = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).cast("double").alias("certain"))
    steps = same(targets, need, "source").select("source", (F.col("target") - F.col("certain")).alias("gap"), F.lit(-1.0).alias("after"), F.array().cast(STEPS).alias("steps"))
    ranks = rows.where("rank is not null").select("source", "size", "rank")
    for _ in range(FILLS):
        steps = _fill(s, ranks, s.save(steps))
    steps = s.save(steps.select("source", "steps"))
    joined = same(base, targets, "source")
    joined = joined.join(tiers.select(F.col("source").alias("_s"), F.col("tier").alias("_t"), "expected"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("tier") == F.col("_t")), "left").drop("_s", "_t")
    joined = joined.join(steps.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    whole = F.floor("expected")
    p = F.col("expected") - whole
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - p) / p)
    rank = F.when(p > 1e-12, odds / (1 + odds))
    joined = joined.withColumn("rank", rank)
    sampled = F.exists("steps", lambda x: (F.col("rank") > x["after"]) & (F.col("size") <= x["gap"] + EPS) & ((F.col("rank") < x["low"]) | (F.col("rank") <= F.coalesce(x["last"], F.lit(-1.0)))))
    copies = F.when(F.col("size") > 0, F.coalesce(whole, F.lit(0)) + F.coalesce(sampled, F.lit(False)).cast("int")).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).select("doc_id", "source", "key", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("expected", F.lit(0.0)).alias("expected"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def same(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys where null equals null, the right side's keys dropped."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on).drop(*[f"_r_{k}" for k in keys])


#: Ranks above ``after`` of documents no longer than ``gap`` are taken below ``low`` and up to ``last``.
STEPS = "array<struct<after:double,gap:double,low:double,last:double>>"


def _fill(s: Scratch, ranks: DataFrame, steps: DataFrame) -> DataFrame:
    """One more step: of the ranks after the last that was skipped, and that fit, the first ones whose words fill the gap."""
    pool = same(ranks, steps.drop("steps"), "source").where((F.col("rank") > F.col("after")) & (F.col("size") <= F.col("gap") + EPS)).select("source", "size", "rank")
    cuts = steps.select("source", F.col("gap").alias("need"), F.lit(0.0).alias("low"), F.lit(1.0).alias("width"))
    for _ in range(ROUNDS):
        cuts = s.save(_narrow(pool, cuts))
    near = same(pool, cuts, "source").where("rank >= low and rank < low + width").groupBy("source", "need", "rank").agg(F.sum("size").alias("size"))
    near = near.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("rank")))
    fits = F.col("upto") <= F.col("need") + EPS
    found = near.groupBy("source").agg(F.max(F.when(fits, F.col("upto"))).alias("took"), F.max(F.when(fits, F.col("rank"))).alias("last"), F.min(F.when(~fits, F.col("rank"))).alias("block"))
    out = same(steps, cuts, "source").join(found.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    step = F.struct("after", "gap", "low", "last")
    # without a rank that is too long nothing is left
    return out.select("source", (F.col("need") - F.coalesce("took", F.lit(0))).alias("gap"), F.coalesce("block", F.lit(2.0)).alias("after"), F.concat("steps", F.array(step)).cast(STEPS).alias("steps"))


def _narrow(pool: DataFrame, cuts: DataFrame) -> DataFrame:
    """One round: the words of each bin of [low, low + width), and the bin in which ``need`` is met as the next range."""
    within = same(pool, cuts, "source").where("rank >= low and rank < low + width")
    at = F.least(F.lit(BINS - 1), F.floor((F.col("rank") - F.col("low")) / F.col("width") * BINS).cast("int"))
    bins = within.groupBy("source", at.alias("bin")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bin")
    bins = same(bins, cuts, "source").withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = bins.where("before <= need").groupBy("source").agg(F.max_by(F.struct("bin", "before"), "bin").alias("hit"))
    out = cuts.join(hit.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    b, w = F.col("hit.bin"), F.col("width") / BINS
    return out.select("source", (F.col("need") - F.coalesce(F.col("hit.before"), F.lit(0))).alias("need"), F.coalesce(F.col("low") + b * w, F.col("low")).alias("low"), F.when(b.isNotNull(), w).otherwise(F.col("width")).alias("width"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target, copies and taken; rows with equal doc_id and text count once.

    The columns of docs come back as they were; where docs has one of these names, the mix's column is named ``mix_`` and that name.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    d, k, *inner = fresh("d", "k", *made)
    m = mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias(d), F.col("key").alias(k), *[F.col(c).alias(x) for c, x in zip(made, inner, strict=True)]).dropDuplicates([d, k])
    out = docs.join(m, F.col("doc_id").eqNullSafe(F.col(d)) & (text_key(F.col("text")) == F.col(k)))
    return out.select(*own(docs), *[F.col(x).alias(c) for c, x in zip(beside(docs, made, "mix_"), inner, strict=True)])
