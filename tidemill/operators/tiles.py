"""All pairs of rows, tile by tile.

Rows lie in blocks of bounded size, blocks in groups; a tile is a pair of groups, and a task. Each row
is sent to one tile in each row and column of the grid, so N rows meet on T tasks by
N * sqrt(2 T) copies through the shuffle, and no task holds more than two groups. Work is N * N by its nature.

A block is one row of a written table: keys ``k``, and columns of numbers, ``width`` of them a key, laid flat. Rows whose vector is
null are in no block; keys are whole numbers and tell rows apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

BLOCK, GROUP, CHUNK = 512, 16_384, 512


@dataclass
class Tiles:
    """``rows``: (g, b, k, x and further columns of numbers); ``groups`` and ``n`` rows."""

    rows: DataFrame
    groups: int
    n: int
    scratch: Scratch = field(repr=False)

    def with_rows(self, rows: DataFrame, *old: DataFrame) -> Tiles:
        """The same grid with a new table of blocks, written; ``old`` tables are deleted."""
        out = Tiles(self.scratch.save(rows), self.groups, self.n, self.scratch)
        self.scratch.drop(*old)
        return out


def groups_for(spark, n: int, size: int, group: int = GROUP) -> int:
    """So many groups that none is above ``group`` rows, and tiles enough for all cores."""
    wanted = 4 * spark.sparkContext.defaultParallelism
    return max(1, -(-n // group), min(-(-n // max(1, size // 8)), int((2 * wanted) ** 0.5) + 1))


def tiles(df: DataFrame, key: str, column: str = "x", size: int = BLOCK, group: int = GROUP, **more: Column) -> Tiles:
    """The blocks of a table of vectors; ``more`` names further columns of one number a row."""
    s = Scratch(df.sparkSession)
    held = df.where(F.col(column).isNotNull())
    n = held.count()
    groups = groups_for(df.sparkSession, n, size, group)
    blocks = max(groups, -(-n // size))
    b = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b")
    row = F.struct(F.col(key).cast("long").alias("k"), F.col(column).cast("array<double>").alias("x"), *[c.cast("double").alias(name) for name, c in more.items()])
    each = held.groupBy(b).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    flat = each.select((F.col("b") % groups).alias("g"), "b", F.col("rows.k").alias("k"), F.flatten("rows.x").alias("x"), *[F.col(f"rows.{name}").alias(name) for name in more])
    return Tiles(s.save(flat), groups, n, s)


class Side:
    """One group's rows in a task: keys, their blocks and slices, and columns as matrices."""

    def __init__(self, pdf: pd.DataFrame):
        self.blocks = pdf["b"].tolist()
        ends = np.cumsum([0, *map(len, pdf["k"])])
        self.slices = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.k = np.concatenate(pdf["k"].tolist())
        self.pdf = pdf

    def __getitem__(self, name: str) -> np.ndarray:
        return np.concatenate(self.pdf[name].tolist()).reshape(len(self.k), -1).astype(float, copy=False)


def over(t: Tiles, f: Callable[[Side, Side, bool], Iterator[dict]], schema: str, reads: list[str] | None = None) -> DataFrame:
    """``f(left, right, same)`` for each tile with rows on both sides; it yields columns of frames of ``schema``. Only the columns it ``reads`` are sent (all by default).

    Blocks of a group reach a task in any order, another one for each shuffle; so a group that meets itself is sent once, and is both sides in one order.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    count = t.groups * (t.groups + 1) // 2
    others = [c for c in t.rows.columns if c in ("b", "k") or c != "g" and (reads is None or c in reads)]
    # each column gets an alias, as the two sides of a cogroup need columns of their own
    left = t.rows.select(F.col("g").alias("ga"), F.explode(F.sequence("g", F.lit(t.groups - 1))).alias("gb"), *[F.col(c).alias(c) for c in others])
    right = t.rows.where("g > 0").select(F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("ga"), F.col("g").alias("gb"), *[F.col(c).alias(c) for c in others])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        same = len(a) > 0 and bool(a["ga"].iat[0] == a["gb"].iat[0])
        if not len(a) or not (same or len(b)):
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        one = Side(a)
        two = one if same else Side(b)
        found = [pd.DataFrame(x) for x in f(one, two, same)]
        return pd.concat(found, ignore_index=True)[names] if found else pd.DataFrame({c: [] for c in names}, dtype=object)

    sides = [d.repartition(count, "ga", "gb").groupBy("ga", "gb") for d in (left, right)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, schema)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by products; close to 0, not 0, between equal rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances by differences: exactly 0 between equal rows."""
    total = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        total += (x[:, k, None] - y[None, :, k]) ** 2
    return np.sqrt(total)


def apart_at(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``apart`` at some places: distances of rows i of x to rows j of y, bit for bit as there."""
    total = np.zeros(len(i))
    for k in range(x.shape[1]):
        total += (x[i, k] - y[j, k]) ** 2
    return np.sqrt(total)


class Rough:
    """Squared distances of rows of x to rows of y by one product, each within ``slack`` of the true one; by differences where the product would overflow or vanish.

    Both sides are taken from the mean of x, as what lies far from the origin would lose its digits.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, kind: type = np.float64):
        self.x, self.y = x, y
        with np.errstate(all="ignore"):
            middle = x.mean(0)
            middle = np.where(np.isfinite(middle), middle, 0.0)
            u, v = x - middle, y - middle
            p, q = (u * u).sum(1), (v * v).sum(1)
        both = np.concatenate([p, q])
        most = both[np.isfinite(both)].max(initial=0.0)
        self.safe = bool(np.isfinite(both).all() and (1e-25 < most < 1e25))
        self.slack = 8 * (x.shape[1] + 4) * float(np.finfo(kind if self.safe else np.float64).eps) * most
        if self.safe:
            self.left = np.column_stack([u, p, np.ones(len(u))]).astype(kind)
            self.right = np.ascontiguousarray(np.column_stack([-2 * v, np.ones(len(v)), q]).T.astype(kind))

    def __call__(self, rows: slice | np.ndarray, cols: slice) -> np.ndarray:
        if self.safe:
            return self.left[rows] @ self.right[:, cols]
        with np.errstate(all="ignore"):
            return apart(self.x[rows], self.y[cols]) ** 2

    def places(self, same: bool) -> Iterator[tuple[slice, slice]]:
        """Pieces of at most CHUNK rows and columns; of one group with itself those on and right of the diagonal."""
        for i in range(0, len(self.x), CHUNK):
            for j in range(i if same else 0, len(self.y), CHUNK):
                yield slice(i, min(i + CHUNK, len(self.x))), slice(j, min(j + CHUNK, len(self.y)))

    def pieces(self, same: bool) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """These with their squared distances."""
        for rows, cols in self.places(same):
            yield rows, cols, self(rows, cols)

    def exact(self, rows: slice, cols: slice, at: np.ndarray) -> np.ndarray:
        """Distances by differences at places of a piece."""
        i, j = np.divmod(at, cols.stop - cols.start)
        return apart_at(self.x, self.y, i + rows.start, j + cols.start)


def multiply(t: Tiles, eps: float, kind: str, panel: str | None, without: float = 0.0) -> DataFrame:
    """(b, y): parts of a kernel matrix times a panel, one or more a block; to be added by block.

    ``degree``: the Gaussian kernel times a column of ones. ``markov``: D^-1/2 K D^-1/2. ``lower_triangle``: the symmetric matrix whose lower triangle, in order of
    keys, is that of D^-1 K. The last two read the degrees in ``deg``, and with ``without`` take that
    multiple of the outer product of the unit vector in ``top`` off the matrix.
    """

    def part(a: Side, b: Side, same: bool) -> Iterator[dict]:
        sides = (a,) if same else (a, b)
        q = [np.ones((len(s.k), 1)) if panel is None else s[panel] for s in sides]
        deg = [s["deg"] for s in sides] if kind != "degree" else None
        away = [without * (s["top"].T @ v) for s, v in zip(sides, q, strict=True)] if without else None
        if kind == "markov":
            q = [v / np.sqrt(d) for v, d in zip(q, deg, strict=True)]
        y = [np.zeros_like(v) for v in q]
        for rows, cols, m in Rough(a["x"], b["x"]).pieces(same):
            diagonal = same and rows == cols
            if diagonal:
                np.fill_diagonal(m, 0.0)
            np.maximum(m, 0, out=m)
            m *= -1 / eps
            np.exp(m, out=m)
            if kind == "lower_triangle":
                m *= np.where(a.k[rows, None] >= b.k[cols], 1 / deg[0][rows], 1 / deg[-1][cols, 0])
            y[0][rows] += m @ q[-1][cols]
            if not diagonal:
                y[-1][cols] += m.T @ q[0][rows]
        for i, s in enumerate(sides):
            v = y[i] / np.sqrt(deg[i]) if kind == "markov" else y[i]
            v = v - s["top"] @ away[-1 - i] if without else v
            yield {"b": s.blocks, "y": [v[rows].ravel() for rows in s.slices]}

    return over(t, part, "b int, y array<double>", ["x", *([panel] if panel else []), *(["deg"] if kind != "degree" else []), *(["top"] if without else [])])


def added(t: Tiles, parts: DataFrame, f: Callable[[pd.Series, np.ndarray], dict], schema: str) -> DataFrame:
    """Each block's row with the sum of its parts, as ``f(row, sum)`` makes it; a block has at most one part for each group."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        row = mine.iloc[0]
        return pd.DataFrame({c: [v] for c, v in (row.to_dict() | f(row, np.sum(np.stack(found["y"].tolist()), axis=0))).items() if c in names})[names]

    mine = t.rows.select(*[F.col(c).alias(c) for c in t.rows.columns])
    return mine.groupBy("b").cogroup(parts.groupBy("b")).applyInPandas(run, schema)
