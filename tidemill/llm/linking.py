"""Links between items that share buckets, without all pairs inside a bucket.

``members`` has one row per (bucket, item): ``bkey`` long, ``item``, ``node`` long, the node
(document) that an item belongs to, and ``central`` int, larger for better representatives. A round compares, in every bucket
that still spans several components, each member with one representative of the
bucket, and joins the nodes of verified pairs. Members whose node is already in
the representative's component need no comparison, as it could add no link
between classes. After ``rounds`` such rounds the members of buckets that still span
several components go to ``rest``, which names all pairs of them that could still
be a link between components. So every pair that shares a bucket is compared, known
to be too far apart, or already in one class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components


def repeated(scratch: Scratch, members: DataFrame) -> DataFrame:
    """The members of buckets that hold several nodes. Counts are pre-aggregated; only keys and longs are shuffled."""
    # written, so that the join is of plain tables, whose hot buckets can be split
    keys = scratch.save(members.groupBy("bkey").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bkey"))
    return scratch.save(members.join(keys.hint("merge"), "bkey", "left_semi"))


def link(scratch: Scratch, members: DataFrame, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame], rounds: int = 3) -> tuple[DataFrame, list[DataFrame]]:
    """(node, comp) for all nodes that a verified pair joins, and the verified pairs of each round.

    ``members`` is a written table in which every bucket holds several nodes. ``verify`` takes
    ``(a, b, na, nb)``, items and their nodes, and returns the verified ones with at least na and nb. ``rest`` takes
    ``(bkey, item, node, comp)`` of open buckets and returns candidates ``(item, node, item2, node2)``.
    """
    spark = members.sparkSession
    comps, found, tried = None, [], None
    for r in range(rounds + 1):
        now = members.withColumn("comp", F.col("node")) if comps is None else members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        now = scratch.save(now) if comps is not None else now
        open_ = now.groupBy("bkey").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bkey")
        if comps is not None:
            open_ = scratch.save(open_)
            if open_.isEmpty():
                break
        live = now.join(open_.hint("merge"), "bkey", "left_semi") if comps is not None else now
        if r < rounds:
            # central items first; the first round takes the same ones in many buckets, later rounds take others
            order = F.lit(0) if r == 0 else F.xxhash64(F.lit(r), "bkey", "item")
            rep = live.groupBy("bkey").agg(F.min(F.struct(-F.col("central"), order.alias("o"), F.col("item"), F.col("node"), F.col("comp"))).alias("rep"))
            pairs = live.join(scratch.save(rep).hint("merge"), "bkey").where("comp != rep.comp").select("item", "node", F.col("rep.item").alias("item2"), F.col("rep.node").alias("node2"))
        else:
            pairs = rest(live)
        first = F.col("node") < F.col("node2")
        pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
        pairs = pairs.select(pick("item", "item2", "a"), pick("item2", "item", "b"), pick("node", "node2", "na"), pick("node2", "node", "nb")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs)
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        found.append(scratch.save(verify(pairs)))
        edges = found[0].select(F.col("na").alias("a"), F.col("nb").alias("b"))
        for x in found[1:]:
            edges = edges.union(x.select(F.col("na").alias("a"), F.col("nb").alias("b")))
        comps = components(scratch, edges)
    return comps if comps is not None else spark.createDataFrame([], "node long, comp long"), found
