"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Rules look at simple measures of a text (shares of symbols, marks, capitals,
repeats, distinct words, word length). Each rule has a ladder of cutoffs from
lenient to strict; level t applies the t-th cutoff of every rule at once. For
each stratum the labelled good rows are a holdout: level t false-rejects k of n
of them, and it is safe if the exact binomial tail P(Bin(n, max_loss) <= k) is at
most delta / (number of strata). Levels are tested from lenient to strict until
the first that is not safe (fixed-sequence testing needs no correction inside a
stratum; Bonferroni covers the strata), so with probability 1 - delta every
stratum loses at most a share max_loss of its good rows.

Nulls: a null text has no words; a null stratum is a stratum of its own; null
doc_ids and null labels take no part in the holdout. A stratum without enough
labelled rows gets no cutoff and keeps what the base rule keeps. Rows that
repeat a doc_id are judged one by one, and are one document in the holdout, rejected if any is; repeated labels of a doc_id count once,
with the lowest quality. Very long texts are measured whole, in the row's own task. Columns of docs other
than doc_id, text and the stratum are not read. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, UPPER, Scratch, blank_words, let

SYMBOLS = "#*$%&|<>"
#: Rule -> cutoffs from lenient to strict; a share above its cutoff (below, for "distinct") rejects.
LADDERS = {
    "symbols": [0.5, 0.35, 0.25, 0.15, 0.08, 0.04],
    "marks": [0.5, 0.3, 0.2, 0.15, 0.1, 0.07],
    "capitals": [0.95, 0.8, 0.7, 0.6, 0.5, 0.4],
    "dup_lines": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25],
    "repeats": [0.19, 0.18, 0.17, 0.16, 0.15, 0.12],
    "word_length": [40.0, 30.0, 24.0, 20.0, 16.0, 14.0],
    "distinct": [0.02, 0.05, 0.1, 0.2, 0.3, 0.35],
}
LEVELS = 6
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of ``width`` words found twice or more in the array."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(ranked: Column) -> Column:
        same = F.filter(ranked, lambda x, j: (F.get(ranked, j - 1)["h"] == x["h"]) | (F.get(ranked, j + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    ranked = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ranked(h), twice)))


def measures(text: Column) -> Column:
    """A struct of the base counts of a text and what the rules need besides."""
    text = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    word_counts = let(blank_words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), repeated_words(w).alias("repeats")))
    return F.struct(
        word_counts.alias("words"), line_counts.alias("lines"), F.length(F.translate(text, BLANKS, "")).alias("chars"),
        without(SYMBOLS).alias("symbols"), without("!?").alias("marks"), without(UPPER).alias("capitals"),
    )


def document_measures(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum, the base columns, and ``level``: the first level that rejects the row (LEVELS: none)."""
    m = docs.select("doc_id", F.col(stratum).alias("stratum"), measures(F.col("text")).alias("m"))
    m = m.select(
        "doc_id", "stratum", F.col("m.words.n").cast("long").alias("n_words"), F.col("m.chars").cast("long").alias("word_chars"), F.col("m.symbols").cast("long").alias("n_symbols"),
        (F.col("m.lines.n") - F.col("m.lines.distinct")).cast("long").alias("n_dup_lines"), F.col("m.words.repeats").cast("long").alias("n_repeat_words"),
        F.col("m.lines.n").alias("n_lines"), F.col("m.words.distinct").alias("n_distinct"), F.col("m.marks").alias("n_marks"), F.col("m.capitals").alias("n_capitals"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    value = {
        "symbols": share("n_symbols", "word_chars"), "marks": share("n_marks", "word_chars"), "capitals": share("n_capitals", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"), "distinct": F.when(F.col("n_words") > 0, share("n_distinct", "n_words")).otherwise(1.0),
    }
    first = F.lit(LEVELS)
    for t in reversed(range(LEVELS)):
        fails = F.lit(False)
        for rule, cutoffs in LADDERS.items():
            fails = fails | ((value[rule] < cutoffs[t]) if rule == "distinct" else (value[rule] > cutoffs[t]))
        first = F.when(fails, t).otherwise(first)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return m.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), first.alias("level"))


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0 to double precision: Stirling's series after a shift by 10."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(10):
        series = series - F.log(x + k)
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from term k down, where terms fall geometrically; 1 where k > n p."""
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)
    odds = (1 - p) / p
    steps = F.sequence(F.lit(0), F.least(k, 40 * F.sqrt(n) + 60).cast("int"))
    fold = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda a, j: F.struct((a["term"] * (k - j) / (n - k + j + 1) * odds).alias("term"), (a["total"] + a["term"]).alias("total")),
    )
    return F.when(k > n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * fold["total"]))


def safe_levels(rows: DataFrame, labels: DataFrame, max_loss: float, delta: float) -> DataFrame:
    """One row per stratum: holdout size, good rows lost at its chosen level, and ``n_levels``, how many levels are safe."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = rows.where("not base_failed").select("doc_id", "stratum", "level").join(marked.where("quality = 1").select("doc_id"), "doc_id")
    # one vote a document: rows that repeat a doc_id count once, with the level that rejects first
    good = good.groupBy("stratum", "doc_id").agg(F.min("level").alias("level"))
    lost = [F.count_if(F.col("level") <= t).alias(f"k{t}") for t in range(LEVELS)]
    held = good.groupBy("stratum").agg(F.count("*").alias("n"), *lost)
    m = max(1, rows.select("stratum").distinct().count())
    levels = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"k{t}").alias("k"), binomial_tail(F.col(f"k{t}"), F.col("n"), max_loss).alias("p")) for t in range(LEVELS)])
    unsafe = F.filter(levels, lambda x: x["p"] > delta / m)
    return held.select("stratum", "n", F.when(F.size(unsafe) > 0, F.array_min(F.transform(unsafe, lambda x: x["t"]))).otherwise(LEVELS).alias("n_levels"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_loss: float = 0.05, delta: float = 0.1) -> DataFrame:
    """Base columns, the row's ``level``, its stratum's ``n_levels``, ``base_failed`` and ``kept`` for each row of docs."""
    rows = Scratch(docs.sparkSession).save(document_measures(docs, stratum))
    chosen = safe_levels(rows, labels, max_loss, delta).withColumnRenamed("stratum", "s")
    out = rows.join(chosen, F.col("stratum").eqNullSafe(F.col("s")), "left").withColumn("n_levels", F.coalesce("n_levels", F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("level") >= F.col("n_levels"))).drop("s", "n")
