"""How filters interact: what each removes, at each place in each order, from one pass over the texts.

A document's outcome under every order follows from its mask, one bit for each filter that it
fails. So the texts are read once, documents are counted by (part, mask, labels), and all that follows works on
these cells: at most 2**filters x 4 a part, whatever the number of documents. Cells are
unpivoted against the steps of all orders; a running bit-or over the earlier steps tells who was
removed before; conditional sums give the metrics of a step, and window totals over a filter's
steps its Shapley sum.

Duplicates are told by a join on (hash of the text, smallest doc_id that has it), so the copies of a text
go separate ways and no group of copies meets in one task.

Nulls: a null text is an empty one, a null source counts as the empty source. A null doc_id is no smaller than
another and none is smaller than it; it has no label. Where a doc_id has several labels, one of 1 is enough; a null label is none. Rows
that repeat in doc_id and text count each, and none is the other's duplicate. Empty and very long texts are documents as any
other. Of the tables only doc_id, source and text, and doc_id, quality and toxic, are read, so other columns may have any name. An empty table
gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, Scratch, blank_words, let

#: The filters in bit order, their bounds, and the characters of D. E, the last, is "duplicate of a smaller doc_id".
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, MARKS = 50, 65, 5, "[#$%&*|]"


def conditions(text: Column) -> Column:
    """The bits of the filters that a non-null text fails by itself: A 1, B 2, C 4, D 8."""
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    own = F.when(100 * capitals > MAX_CAPITALS_PERCENT * F.length(text), 4).otherwise(0) + F.when(text.rlike(MARKS), 8).otherwise(0)
    few = let(blank_words(text), lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w), 2).otherwise(0))
    return own + few


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents of one source, one set of failed filters and one pair of labels, counted."""
    s = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), conditions(text).alias("own"))
    base = s.save(base)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_d")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    first = base.where("doc_id is not null").groupBy(F.col("key").alias("_k")).agg(F.min("doc_id").alias("_d"))
    first = first.withColumn("first", F.lit(True))
    rows = base.join(marks, F.col("doc_id") == F.col("_d"), "left").drop("_d")
    rows = rows.join(first, (F.col("key") == F.col("_k")) & (F.col("doc_id") == F.col("_d")), "left")
    later = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    no = F.lit(False)
    return rows.groupBy("part", (F.col("own") + later).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count("*").alias("n"))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    part, filter_order, step (from 1), kept (after the step), removed (at it), redundant (fail its filter, removed earlier),
    unique_fails (fail its filter alone), good_lost, toxic_lost (of the removed), shapley (what its
    filter removes, summed over all orders).
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    bit = F.lit(0)
    for k, name in enumerate(filters):
        bit = F.when(F.col("filter") == name, 1 << k).otherwise(bit)
    steps = steps.withColumn("bit", bit)
    path = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step")
    seen = F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("seen", seen)
    fails, gone, n = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("seen") != 0, F.col("n")
    count = lambda c: F.sum(F.when(c, n).otherwise(F.lit(0).cast("long")))
    removed = fails & ~gone
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        count(~fails & ~gone).alias("kept"), count(removed).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"), count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    whole = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return out.withColumn("shapley", whole).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters over documents and their labels."""
    return audit(Scratch(docs.sparkSession).save(cells(docs, labels)))
