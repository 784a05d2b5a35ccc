"""Density modes on a neighbour graph, with persistence (Chazal, Guibas, Oudot, Skraba 2013), in grouped rounds.

Each row points to its densest neighbour if that is denser than itself; pointer
jumping over the pointers gives every row its peak. Edges between basins meet at the
lower of their two densities; the highest meeting of two basins, from one
group-by, is a saddle. By the elder rule the lower of two peaks dies where their basins meet.

Deaths are found for all basins at once (``merge_tree``): nothing is collected but one number of modes for each graph. Several graphs, as one for each number of
neighbours, go through the same rounds, told apart by ``g``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import Scratch
from . import ordered


def follow(s: Scratch, pointers: DataFrame) -> DataFrame:
    """(g, c, up) with ``up`` the last of the chain of pointers from c; ends point to themselves. Each round halves the chains and is a table."""
    cur = s.save(pointers.select("g", "c", "up"))
    while True:
        top = cur.select("g", F.col("c").alias("up"), F.col("up").alias("_top"))
        nxt = s.save(cur.join(top, ["g", "up"], "left").select("g", "c", F.coalesce("_top", "up").alias("up"), (F.col("_top") != F.col("up")).alias("moved")))
        s.drop(cur)
        if nxt.where("moved").isEmpty():
            out = nxt.drop("moved")
            out.path = nxt.path
            return out
        cur = nxt


def basins(edges: DataFrame) -> DataFrame:
    """(g, i, peak, f) from edges (g, i, j, kde): f is the row's density, ties by smaller row number."""
    f = edges.groupBy("g", F.col("i").alias("j")).agg(F.max("kde").alias("fj"))
    up = edges.join(f, ["g", "j"]).groupBy("g", "i").agg(F.max("kde").alias("f"), F.max(F.struct(F.col("fj"), (-F.col("j")).alias("m"))).alias("best"))
    higher = (F.col("best.fj") > F.col("f")) | ((F.col("best.fj") == F.col("f")) & (-F.col("best.m") < F.col("i")))
    s = Scratch(edges.sparkSession)
    up = s.save(up.select("g", F.col("i").alias("c"), F.when(higher, -F.col("best.m")).otherwise(F.col("i")).alias("up"), "f"))
    tops = follow(s, up)
    return up.drop("up").join(tops, ["g", "c"]).select("g", F.col("c").alias("i"), F.col("up").alias("peak"), "f")


def saddles(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(g, a, b, saddle) for each pair of basins that an edge joins, peaks in order."""
    l, r = (rows.select("g", F.col("i").alias(e), F.col("peak").alias(f"p{e}"), F.col("f").alias(f"f{e}")) for e in "ij")
    met = edges.select("g", "i", "j").join(l, ["g", "i"]).join(r, ["g", "j"]).where("pi != pj")
    return met.groupBy("g", F.least("pi", "pj").alias("a"), F.greatest("pi", "pj").alias("b")).agg(F.max(F.least("fi", "fj")).alias("saddle"))


def _key(*before: str) -> Column:
    """Saddles in the order in which basins meet, the first as the greatest: by falling height, then by their two peaks."""
    return F.struct(*before, "s", "na", "nb")


def merge_tree(peaks: DataFrame, met: DataFrame) -> DataFrame:
    """(g, low, high, death) of each peak that dies, from peaks (g, p, f) and saddles (g, a, b, saddle), as from the highest saddle down.

    Every component hooks over its highest saddle, which gives trees whose saddles rise towards the root (as in Boruvka's algorithm). What a tree's
    components do down to the highest saddle that leaves the tree does not depend on others: there they join the root's cluster in order of their
    saddles, so a running maximum of the peaks tells who meets whom, and the lower dies. Components below that saddle wait for the next
    round; in each round every tree loses one component at least. A component goes by its highest peak.
    """
    s = Scratch(peaks.sparkSession)
    heights = s.save(peaks.select("g", F.col("p").alias("c"), "f"))
    edges = s.save(met.select("g", F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("saddle").alias("s"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb")))
    found = []
    while not edges.isEmpty():
        both = edges.select("g", F.col("ca").alias("c"), F.col("cb").alias("o"), "s", "na", "nb").union(edges.select("g", "cb", "ca", "s", "na", "nb"))
        best = both.groupBy("g", "c").agg(F.max(F.struct("s", "na", "nb", "o")).alias("e")).select("g", "c", "e.*")
        best = s.save(best)
        back = best.select("g", F.col("c").alias("o"), F.col("o").alias("_back"))
        hooks = best.join(back, ["g", "o"]).withColumn("up", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")))
        tops = follow(s, hooks)
        name = lambda end: tops.select("g", F.col("c").alias(f"c{end}"), F.col("up").alias(f"t{end}"))
        apart = edges.join(name("a"), ["g", "ca"]).join(name("b"), ["g", "cb"]).where("ta != tb")
        leaves = apart.select("g", F.col("ta").alias("t"), _key().alias("k")).union(apart.select("g", "tb", _key())).groupBy("g", "t").agg(F.max("k").alias("out"))
        nodes = tops.withColumnRenamed("up", "t").join(best, ["g", "c"]).join(leaves, ["g", "t"], "left").join(heights, ["g", "c"])
        root = F.col("c") == F.col("t")
        nodes = nodes.where(root | F.col("out").isNull() | (_key() > F.col("out")))
        nodes = nodes.select("g", "t", "c", root.alias("is_root"), "s", (~root).alias("after"), (-F.col("s")).alias("depth"), (-F.col("na")).alias("a"), (-F.col("nb")).alias("b"), F.struct("f", (-F.col("c")).alias("m")).alias("peak"))
        placed = ordered.positions(nodes, ["after", "depth", "a", "b"], ["g", "t"])
        run = s.save(ordered.running(placed, {"eldest": ("max", "peak")}, ["g", "t"], itself=False))
        found.append(s.save(run.where("not is_root").select("g", (-F.least("peak", "eldest")["m"]).alias("low"), (-F.greatest("peak", "eldest")["m"]).alias("high"), F.col("s").alias("death"))))
        eldest = run.groupBy("g", "t").agg((-F.max("peak")["m"]).alias("now"))
        moved = s.save(run.select("g", "t", "c").join(eldest, ["g", "t"]).select("g", "c", "now"))
        for end in "ab":
            to = moved.select("g", F.col("c").alias(f"c{end}"), F.col("now").alias("_now"))
            again = (again if end == "b" else edges).join(to, ["g", f"c{end}"], "left").withColumn(f"c{end}", F.coalesce("_now", f"c{end}")).drop("_now")
        again = again.where("ca != cb").groupBy("g", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max(_key()).alias("k"))
        nxt = s.save(again.select("g", F.col("x").alias("ca"), F.col("y").alias("cb"), "k.*"))
        s.drop(edges, best, tops, run, moved)
        edges = nxt
    if not found:
        return peaks.sparkSession.createDataFrame([], "g int, low long, high long, death double")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def mode_counts(died: DataFrame) -> dict[int, int]:
    """g -> m - argmax of the gaps between sorted deaths, m of them; graphs of fewer than two deaths are left out."""
    placed = ordered.positions(died.select("g", "low", "death"), ["death", "low"], ["g"])
    gaps = ordered.previous(placed, {"_before": "death"}, 1, ["g"])
    best = F.max(F.when(F.col("idx") > 0, F.struct((F.col("death") - F.col("_before")).alias("gap"), (-F.col("idx")).alias("at"))))
    return {r["g"]: r["m"] + r["best"]["at"] + 1 for r in gaps.groupBy("g").agg(F.count("*").alias("m"), best.alias("best")).collect() if r["m"] > 1}


def labels(rows: DataFrame, died: DataFrame, n: int) -> DataFrame:
    """(i, label) of one graph with ``n`` modes left, labels from 0 by falling density of the peak.

    The peaks of least persistence (height over death, then number) are merged into those that they met.
    """
    s = Scratch(rows.sparkSession)
    peaks = s.save(rows.where("i = peak").select(F.col("i").alias("c"), "f"))
    gone = max(0, peaks.count() - n)
    order = died.join(peaks.withColumnRenamed("c", "low"), "low").select("low", "high", (F.col("f") - F.col("death")).alias("life"))
    merged = ordered.positions(order, ["life", "low"]).where(F.col("idx") < gone).select(F.col("low").alias("c"), F.col("high").alias("up"))
    tops = follow(s, peaks.join(merged, "c", "left").select(F.lit(0).alias("g"), "c", F.coalesce("up", "c").alias("up")))
    left = ordered.positions(tops.where("c = up").join(peaks, "c").select("c", (-F.col("f")).alias("depth")), ["depth", "c"], name="label")
    named = tops.select(F.col("c").alias("peak"), F.col("up").alias("c")).join(left, "c").select("peak", F.col("label").cast("int"))
    return s.save(rows.select("i", "peak").join(named, "peak").select("i", "label"))


def clusters(edges: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Basins, deaths and numbers of modes of graphs ``edges`` (g, i, j, kde)."""
    s = Scratch(edges.sparkSession)
    rows = s.save(basins(edges))
    died = s.save(merge_tree(rows.where("i = peak").select("g", F.col("i").alias("p"), "f"), saddles(edges, rows)))
    return rows, died, mode_counts(died)


def cluster(edges: DataFrame, n_modes: int | None = None) -> tuple[DataFrame, int]:
    """(i, label) of edges (i, j, kde) with labels from 0 by falling density of the peak, and the number of modes that persistence suggests, 1 without two deaths."""
    rows, died, found = clusters(edges.select(F.lit(0).alias("g"), "i", "j", "kde"))
    n = n_modes or found.get(0, 1)
    return labels(rows, died, n), n


def search(neighbour_edges: DataFrame, ks: tuple[int, ...]) -> tuple[DataFrame, int, int]:
    """Labels, k and the number of modes for the k with most modes (the first on ties). ``neighbour_edges`` has max(ks) ranks; all k share the rounds."""
    graphs = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))
    edges = Scratch(neighbour_edges.sparkSession).save(neighbour_edges.select(F.explode(graphs).alias("g"), "i", "j", "kde"))
    rows, died, found = clusters(edges)
    k = max(ks, key=lambda k: (found.get(k, 1), -ks.index(k)))
    n = found.get(k, 1)
    return labels(rows.where(F.col("g") == k), died.where(F.col("g") == k), n), k, n
