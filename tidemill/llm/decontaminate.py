"""Benchmark decontamination by a broadcast hash set of n-grams, in DataFrame functions only.

Terms are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``width``
consecutive terms of an item; a shorter item with a term is one window. The windows'
texts are the join key, so every hit is verified term by term by the join itself.
The set is broadcast only while its counted size is below ``broadcast_rows``;
beyond that the same join shuffles.

Nulls: a null text has no terms; items with a null item_id count as one item named
"null" by no one: they mark words as hit, but add no id. Rows that repeat a doc_id
stay rows of their own; items that repeat an item_id are one item. Empty tables
give no hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, own, terms

WIDTH = 10


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per distinct window: ``gram``, its length ``n`` and the sorted ids of its ``items``."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.transform(F.sequence(i, i + n - 1), lambda k: F.get("w", k)), " "))
    return w.select("item_id", n.alias("n"), F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram", "n").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _known_words(benchmark: DataFrame, bits: int = 1 << 18):
    """A test of whether a word may stand in the benchmark: one bit per hash value, so its size does not depend on the tables."""
    slot = lambda x: F.pmod(F.hash(x), F.lit(bits))
    found = benchmark.select(F.explode(terms(F.col("text"))).alias("w")).select(slot(F.col("w")).alias("at")).distinct().collect()  # at most ``bits`` rows
    longs = [0] * (bits // 64)
    for (at,) in found:
        longs[at >> 6] |= 1 << (at & 63)
    table = F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in longs)), ",").cast("array<bigint>")  # folded into one constant
    return lambda x: F.getbit(F.get(table, F.shiftright(slot(x), 6)), slot(x).bitwiseAND(F.lit(63))) == 1


def covered(spans: Column) -> Column:
    """Positions that lie in spans of (start, n), given sorted."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        end = F.greatest(a["end"], x["start"] + x["n"])
        return F.struct((a["total"] + end - F.greatest(a["end"], x["start"])).alias("total"), end.alias("end"))

    return F.aggregate(spans, zero, step)["total"]


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_rows: int = 500_000) -> DataFrame:
    """For each row of docs (numbered ``row`` in this plan): n_words, ``spans`` of hits, ``items`` that occur."""
    grams = item_windows(benchmark, width)
    sizes = {r["n"]: r["rows"] for r in grams.groupBy("n").agg(F.count("*").alias("rows")).collect()}  # at most ``width`` rows
    known = _known_words(benchmark)
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), terms(F.col("text")).alias("w"))

    def windows(w: Column) -> Column:
        none = F.lit(None).cast("string")
        rows = [F.array(F.struct(F.lit(-1).alias("start"), F.size(w).alias("n"), none.alias("gram")))]  # carries n_words, and rows without hits
        for n in sorted(sizes):
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
            rows.append(let(F.transform(w, known), lambda k: F.transform(F.filter(starts, all_known(k, n)), gram(w, n))))  # noqa: B023
        return F.concat(*rows)

    def all_known(flags: Column, n: int):
        def test(i: Column) -> Column:
            out = F.get(flags, i)
            for k in sorted(range(1, n), key=lambda k: (-k & 3, k)):
                out = out & F.get(flags, i + k)
            return out

        return test

    def gram(w: Column, n: int):
        return lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]).alias("gram"))

    each = words.select("doc_id", "row", F.inline(let(F.col("w"), windows)))
    grams = F.broadcast(grams) if sum(sizes.values()) <= broadcast_rows else grams
    found = each.join(grams.select("gram", "items"), "gram", "left").where("start < 0 or items is not null")
    span = F.when(F.col("start") >= 0, F.struct("start", "n"))
    return found.groupBy("row").agg(
        F.max(F.when(F.col("start") < 0, F.col("doc_id"))).alias("doc_id"), F.max(F.when(F.col("start") < 0, F.col("n"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_list(span)).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), spans and contaminated, for each row of docs."""
    h = hits(docs, benchmark, width, broadcast_rows)
    return h.select("doc_id", "n_words", covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"), "spans", (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs; rows with a null doc_id are matched by their text."""
    (key,) = fresh("key")
    keyed = docs.withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")))
    seen = decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, width)
    bad = seen.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    # a null field would never be equal: compare its text form
    flat = lambda k: F.to_json(k)
    return keyed.withColumn(key, flat(F.col(key))).join(bad.withColumn(key, flat(F.col(key))).hint("merge"), key, "left_anti").select(*own(docs))
