"""Pieces that the text operators share: shared-folder tables, word rules, graph components.

Every operator takes DataFrames and returns DataFrames. Intermediate results that
are read more than once, or that end a round of an iteration, are written as
Parquet below ``spark.checkpoint.dir``, so a lost executor costs the running
tasks only, and no lineage grows over rounds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import Scratch as Scratch

#: The characters that end a word in whitespace-separated text.
BLANKS = " \t\n\x0b\f\r"
#: The characters outside [0-9a-z] and code points from U+0080 on, after lower-casing A-Z.
NOT_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def fresh(*names: str) -> list[str]:
    """Names for columns inside a plan that no table of a user has: those given and a random end."""
    end = uuid.uuid4().hex
    return [f"{n}_{end}" for n in names]


def own(docs: DataFrame) -> list[Column]:
    """The columns of docs as they are."""
    return [F.col(f"`{c}`") for c in docs.columns]


def beside(docs: DataFrame, made: tuple[str, ...], prefix: str) -> list[str]:
    """Names for columns that are made beside those of docs: a name that docs has takes the prefix."""
    return [f"{prefix}{c}" if c in docs.columns else c for c in made]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda reads it."""
    return F.transform(F.array(value), body)[0]


def blank_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def terms(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(F.regexp_replace(lowered, NOT_TERM, " "), " "), "")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null and empty share one key."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def bodies(scratch: Scratch, keyed: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node, ...) with the ``text`` of each node, once.

    ``keyed`` has (doc_id, text, key), ``rows`` a written (doc_id, key, node) of it. One doc_id of each text is
    chosen first, so that the copies of a text go separate ways in the join that carries texts.
    """
    chosen = scratch.save(rows.groupBy("key", "node").agg(F.min("doc_id").alias("d")).join(wanted.hint("merge"), "node").withColumnRenamed("key", "k"))
    on = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    out = scratch.save(keyed.join(chosen.hint("merge"), on).drop("doc_id", "d", "key", "k"))
    # rows that repeat in doc_id and text are still there
    twice = scratch.save(out.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
    if twice.isEmpty():
        return out
    return out.join(twice.hint("merge"), "node", "left_anti").union(out.join(twice.hint("merge"), "node", "left_semi").dropDuplicates(["node"]))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): one row ``(node, comp)`` for each node, comp its smallest node.

    Rounds of hooking and contraction: each component hooks onto its smallest
    neighbour, chains of hooks are shortened by pointer jumping, and the edges are
    relabelled and made distinct, so their number shrinks by round. Minima are
    pre-aggregated and labels are joined, so that a hub does not meet in one task.
    """
    left = scratch.save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        hook = scratch.save(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")))
        while True:
            up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            jumped = scratch.save(hook.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"), F.col("up").isNotNull().alias("moved")))
            scratch.drop(hook)
            hook = jumped.select("node", "comp")
            hook.path = jumped.path
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            ends = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
            new = ends.join(hook, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
        else:
            up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            new = labels.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        new = scratch.save(new)
        for end in "ab":
            up = hook.select(F.col("node").alias(end), F.col("comp").alias("up"))
            moved = (moved if end == "b" else left).join(up, end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        nxt = scratch.save(moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        scratch.drop(hook, left, *([labels] if labels is not None else []))
        left, labels = nxt, new
    scratch.drop(left)
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "node long, comp long")


def extended(scratch: Scratch, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, comp), as ``components`` makes them, after ``edges(a, b)`` more; only labels are walked again."""
    for end in "ab":
        up = labels.select(F.col("node").alias(end), F.col("comp").alias("up"))
        edges = edges.join(up.hint("merge"), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
    more = components(scratch, edges)
    new = more.join(labels.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("comp"))
    up = more.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    return scratch.save(labels.union(new).join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
