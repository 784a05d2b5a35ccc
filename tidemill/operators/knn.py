"""Nearest neighbours by an inverted file: rows in cells around centroids, each query compared with its nearest cells only.

Centroids are fitted on a sample of at most ``SAMPLE`` rows chosen by a hash of the key; every row is indexed. How many cells a query visits
is settled by measuring: the true neighbours of at most ``JUDGES`` rows, found by one pass over all rows, must lie in the visited cells with
the asked share; without a share, all cells are visited, and the search is exact. Groups of whole cells meet in tiles, as in ``tiles``, and a tile compares each query with the members in the cells that it visits: a row is sent to
each group once, however many cells it visits. A hot cell is dealt to several groups. Work is about N * visited * N / cells instead of N * N.

Copies: only the k + 1 smallest keys of equal vectors are in the index, as no other copy can be among anybody's k nearest (ties go by key), and equal
vectors are searched once. The Gaussian density counts all copies; rows outside the visited cells add nothing to it. Rows without a vector are left out; keys are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .spectral import best_of, nearest_of
from .tiles import BLOCK, CHUNK, Rough, Side, Tiles, apart, groups_for, over, squares

SAMPLE, JUDGES, MAX_CELLS, SALTS = 65_536, 256, 4096, 16


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in values]) if len(values) else np.zeros((0, 1))


def centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Lloyd's rounds on the bounded sample, from rows of it; a centroid without rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        best, dist = nearest_cells(sample, at, 1)
        own, dist = best[:, 0], dist[:, 0]
        n = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
        empty = np.flatnonzero(n == 0)
        at[empty] = sample[np.argsort(-dist, kind="stable")[: len(empty)]]
    return at


def nearest_cells(x: np.ndarray, at: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ``count`` nearest centroids of each row, nearest first, and the squared distances; in slices of rows."""
    names, dist = [], []
    for i in range(0, len(x), 1024):
        d = squares(x[i : i + 1024], at)
        order = np.argsort(d, axis=1, kind="stable")[:, :count]
        names.append(order)
        dist.append(np.take_along_axis(d, order, 1))
    return (np.concatenate(names), np.concatenate(dist)) if names else (np.zeros((0, count), int), np.zeros((0, count)))


@dataclass
class Index:
    """``members`` (cls, k, place, weight, x, cell): the indexed rows; ``rows`` (k, cls): all rows; the centroids; cells to visit; the recall that was measured."""

    members: DataFrame
    rows: DataFrame
    at: np.ndarray
    visit: int
    recall: float
    scratch: Scratch


def build(df: DataFrame, key: str, column: str = "x", k: int = 20, recall: float | None = 0.95, cells: int | None = None, seed: int = 42) -> Index:
    """The index for searches of up to ``k`` neighbours; with ``recall`` None they compare all rows with all, and cells serve only to bound what a group sends."""
    s = Scratch(df.sparkSession)
    x = F.col(column).cast("array<double>")
    rows = s.save(df.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("k"), F.md5(x.cast("string")).alias("cls"), x.alias("x")))
    n = rows.count()
    cells = max(1, min(MAX_CELLS, cells or int(n**0.5)))
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "k"), "k").limit(min(SAMPLE, 64 * cells))
    at = centroids(_matrix([r.x for r in picked.select("x").collect()]), cells, seed=seed) if n else np.zeros((1, 1))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=nearest_cells(_matrix(b["x"].tolist()), at, 1)[0][:, 0] if len(b) else [])

    copies = rows.groupBy("cls").agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy("k"))).where(F.col("place") <= k + 1)
    weight = F.when((F.col("place") == k + 1) & F.col("n").isNotNull(), F.col("n") - k).otherwise(1)
    members = first.join(copies, "cls", "left").select("cls", "k", "place", weight.cast("double").alias("weight"), "x")
    members = s.save(members.mapInPandas(home, "cls string, k long, place int, weight double, x array<double>, cell int"))
    visit, found = (len(at), 1.0) if recall is None else _settle(rows, members, at, k, recall, seed) if n > 1 else (1, 1.0)
    return Index(members, rows.select("k", "cls"), at, visit, found, s)


def _settle(rows: DataFrame, members: DataFrame, at: np.ndarray, k: int, recall: float, seed: int) -> tuple[int, float]:
    """The least number of cells that hold the asked share of the true neighbours of the judged rows, and that share."""
    picked = rows.orderBy(F.xxhash64(F.lit(seed + 1), "k"), "k").limit(JUDGES).collect()
    keys, x = np.array([r.k for r in picked]), _matrix([r.x for r in picked])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 4 * BLOCK):
                some = b.iloc[i : i + 4 * BLOCK]
                d = apart(x, _matrix(some["x"].tolist()))
                d[keys[:, None] == some["k"].to_numpy()] = np.inf
                cell = dict(zip(some["k"], some["cell"], strict=True))
                yield pd.DataFrame({"q": np.arange(len(x)), "near": [[{**e, "cell": int(cell[e["j"]])} for e in near] for near in best_of(d, some["k"].to_numpy(), k)]})

    near = members.select("k", "x", "cell").mapInPandas(part, "q int, near array<struct<dist:double,j:long,cell:int>>")
    true = near.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")).select("q", F.col("near.cell").alias("cell")).collect()
    order, _ = nearest_cells(x, at, len(at))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(at))[None], 1)
    needed = np.sort(np.concatenate([rank[r.q, r.cell] for r in true if r.cell]) + 1)
    visit = int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)])
    return visit, float((needed <= visit).mean())


def _grouped(index: Index, size: int) -> Tiles:
    """The members as tiles whose groups are whole cells, one after the other; a cell above a group's share is dealt to several by a hash. There is one row of counts for each cell, MAX_CELLS at most."""
    counts = {r.cell: r.n for r in index.members.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    groups = groups_for(index.members.sparkSession, n, size)
    share, held, homes = max(1.0, n / groups), 0.0, []
    for cell, m in sorted(counts.items()):
        parts = int(-(-m // share))
        homes.append((cell, [min(groups - 1, int((held + (p + 0.5) * m / parts) / share)) for p in range(parts)]))
        held += m
    to = index.members.sparkSession.createDataFrame(homes, "cell int, homes array<int>")
    g = F.get("homes", F.pmod(F.xxhash64("k"), F.size("homes")).cast("int"))
    b = F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(max(1, int(share) // size))).cast("int")
    row = F.struct("k", "x", "weight", F.col("cell").cast("double").alias("cell"), (F.col("place") == 1).cast("double").alias("asked"))
    each = index.members.join(F.broadcast(to), "cell").groupBy(g.alias("g"), b.alias("b")).agg(F.collect_list(row).alias("rows"))
    flat = each.select("g", "b", F.col("rows.k").alias("k"), F.flatten("rows.x").alias("x"), *[F.col(f"rows.{c}").alias(c) for c in ("weight", "cell", "asked")])
    return Tiles(index.scratch.save(flat), groups, n, index.scratch)


def search(index: Index, k: int = 20, bandwidth: float | None = None, size: int = BLOCK) -> DataFrame:
    """(i, j, dist, rank, kde) for every row: its k nearest other rows as far as the visited cells hold them, ties by j."""
    s, at, visit = index.scratch, index.at, index.visit
    t = _grouped(index, size)

    kind = np.float64 if bandwidth else np.float32

    def pieces(one: Side, two: Side) -> Iterator[tuple]:
        """Asked rows of one side against the members of the other: their places, the rough distances, keys and weights of the members, and the rough squares, infinite outside the visited cells."""
        asked, order = np.flatnonzero(one["asked"][:, 0] > 0), np.argsort(two["cell"][:, 0], kind="stable")
        if not len(asked):
            return
        x, keys, weight = one["x"][asked], two.k[order], two["weight"][order, 0]
        r = Rough(x, two["x"][order], kind)
        cells, first = np.unique(two["cell"][order, 0].astype(int), return_index=True)
        spans = [slice(i, j) for i, j in zip(first, [*first[1:], len(keys)], strict=True)]
        for i in range(0, len(x), CHUNK):
            rows = slice(i, min(i + CHUNK, len(x)))
            if visit >= len(at):
                yield asked[rows], rows, r, keys, weight, r(rows, slice(0, len(keys)))
                continue
            visited = np.zeros((rows.stop - i, len(at)), bool)
            np.put_along_axis(visited, nearest_cells(x[rows], at, visit)[0], True, 1)
            d = np.full((rows.stop - i, len(keys)), np.inf, kind)
            for c, span in zip(cells, spans, strict=True):
                q = np.flatnonzero(visited[:, c])
                if len(q):
                    d[q, span] = r(q + i, span)
            yield asked[rows], rows, r, keys, weight, d

    names = t.rows.columns

    def bounded(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Side(pdf)
        most = np.full(len(own.k), np.inf)
        for places, _, r, keys, _, d in pieces(own, own):
            if len(keys) > k + 1:
                most[places] = np.partition(d, k + 1, axis=1)[:, k + 1].astype(float) + 2 * r.slack
        return pdf.assign(most=[most[rows] for rows in own.slices])[[*names, "most"]]

    # what a row's own group holds bounds its k-th distance, so other groups send only what lies nearer
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.rows.schema)
    t = t.with_rows(t.rows.repartition(t.groups, "g").groupBy("g").applyInPandas(bounded, types + ", most array<double>"), t.rows)

    def compare(a: Side, b: Side, same: bool) -> Iterator[dict]:
        for one, two in ((a, b),) if same else ((a, b), (b, a)):
            bound = one["most"][:, 0]
            for places, rows, r, keys, weight, d in pieces(one, two):
                near = nearest_of(r, None, keys, rows, d, k + 1, bound[places])
                kde = np.zeros(len(d))
                if bandwidth:
                    np.maximum(d, 0, out=d)
                    d /= -2 * bandwidth**2
                    kde = np.exp(d, out=d) @ weight
                yield {"c": one.k[places], "kde": kde} | near

    each = over(t, compare, "c long, dist array<double>, j array<bigint>, kde double").select("c", "kde", F.arrays_zip("dist", "j").alias("near"))
    best = each.groupBy("c").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"), F.sum("kde").alias("kde"))
    best = s.save(best.join(index.members.where("place = 1").select(F.col("k").alias("c"), "cls"), "c").drop("c"))
    many = s.save(index.rows.groupBy("cls").agg(F.count("*").alias("n"), F.min("k").alias("i")))
    single = best.join(many.where("n = 1").select("cls", "i"), "cls")
    # classes of copies: their result is sent to SALTS tasks each
    copied = best.join(many.where("n > 1").select("cls"), "cls").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = index.rows.select(F.col("k").alias("i"), "cls", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int").alias("salt"))
    out = single.select("i", "near", "kde").union(rows.join(copied, ["cls", "salt"]).select("i", "near", "kde"))
    out = out.select("i", "kde", F.slice(F.filter("near", lambda e: e["j"] != F.col("i")), 1, k).alias("near"))
    return out.select("i", "kde", F.posexplode("near").alias("rank", "n")).select("i", F.col("n.j").alias("j"), F.col("n.dist").alias("dist"), (F.col("rank") + 1).alias("rank"), "kde")
