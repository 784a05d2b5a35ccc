"""Order over a whole table without a task that holds it: positions, neighbours in order, running sums and recursions.

Rows are dealt by ranges of the order and written; each piece counts its rows, the counts of earlier pieces give its offset. Once rows have positions, they
fall into blocks of ``BLOCK`` positions, and a row that a frame of the next block reaches goes there too (a halo), so that every window is over
one block. What must pass from block to block (sums, maxima, affine maps) is one row a block, is put together in order, and is handed back.

A series is what ``keys`` tell apart, or the whole table; positions are 0, 1, 2, ... in each. Rows whose order is equal are numbered in any order, the
same for all who read the result; give an order without ties where it matters, also since equal rows are dealt to one range.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

BLOCK = 1 << 16


def positions(df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "idx", pieces: int | None = None) -> DataFrame:
    """df with the position of each row in its series. One row for each piece (and series in it) is brought together in order."""
    keys, s = keys or [], Scratch(df.sparkSession)
    by = [*keys, *order]
    dealt = (df.repartitionByRange(pieces, *by) if pieces else df.repartitionByRange(*by)).sortWithinPartitions(*by)
    cut = s.save(dealt.withColumn("_row", F.monotonically_increasing_id()))
    piece = F.shiftright("_row", 33)
    held = cut.groupBy(*keys, piece.alias("_piece")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    if keys:
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
        offsets = held.select(*keys, "_piece", "_first", F.coalesce(before, F.lit(0)).alias("_offset"))
    else:
        rows, at = [], 0
        for r in held.orderBy("_piece").collect():  # as many as partitions
            rows.append((r["_piece"], r["_first"], at))
            at += r["_n"]
        offsets = df.sparkSession.createDataFrame(rows, "_piece long, _first long, _offset long")
    out = cut.withColumn("_piece", piece).join(offsets, [*keys, "_piece"])
    return out.withColumn(name, F.col("_offset") + F.col("_row") - F.col("_first")).select(*df.columns, name)


def framed(df: DataFrame, make: Callable[[object], dict[str, Column]], before: int = 0, after: int = 0, keys: list[str] | None = None, at: str = "idx", block: int = BLOCK) -> DataFrame:
    """df with columns over frames that reach ``before`` positions back and ``after`` ahead; ``make`` gets the window in order of positions.

    Each row is sent to the blocks whose frames reach it: its own, and at the edges the next ones.
    """
    div = lambda c: F.floor(c / block).cast("long")
    sent = df.withColumn("_block", F.explode(F.sequence(div(F.greatest(F.col(at) - after, F.lit(0))), div(F.col(at) + before))))
    w = Window.partitionBy(*(keys or []), "_block").orderBy(at)
    return sent.withColumns(make(w)).where(F.col("_block") == div(F.col(at))).drop("_block")


def previous(df: DataFrame, columns: dict[str, str], lag: int = 1, keys: list[str] | None = None, at: str = "idx", block: int = BLOCK) -> DataFrame:
    """Adds, for name -> column, the column's value ``lag`` positions before; null for the first rows."""
    return framed(df, lambda w: {name: F.lag(c, lag).over(w) for name, c in columns.items()}, before=lag, keys=keys, at=at, block=block)


def running(df: DataFrame, columns: dict[str, tuple[str, str]], keys: list[str] | None = None, at: str = "idx", block: int = BLOCK, itself: bool = True) -> DataFrame:
    """Adds, for name -> (``sum``, ``max`` or ``min``, column), the value over all rows of the series up to this one, or with ``itself`` false, before it."""
    keys = keys or []
    own = F.floor(F.col(at) / block).cast("long")
    f = {"sum": F.sum, "max": F.max, "min": F.min}
    join = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest, "min": F.least}
    rows = Scratch(df.sparkSession).save(df.withColumn("_block", own))
    inside = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    totals = rows.groupBy(*keys, "_block").agg(*[f[kind](c).alias(f"_t_{name}") for name, (kind, c) in columns.items()])
    past = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carried = totals.select(*keys, "_block", *[f[kind](f"_t_{name}").over(past).alias(f"_c_{name}") for name, (kind, _) in columns.items()])
    local = rows.withColumns({f"_l_{name}": f[kind](c).over(inside) for name, (kind, c) in columns.items()}).join(carried, [*keys, "_block"])
    return local.select(*df.columns, *[join[kind](F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name) for name, (kind, _) in columns.items()])


def recursion(df: DataFrame, factor: str, term: str, start: float = 0.0, name: str = "state", keys: list[str] | None = None, at: str = "idx", block: int = BLOCK) -> DataFrame:
    """Adds x[t] = factor[t] * x[t-1] + term[t], with x[-1] = ``start``, in order of positions.

    A block is one affine map of the value before it. Maps are found for all blocks at once, put together in order, and each block is then filled in
    from the value that it starts with. Null factors or terms count as 1 and 0.
    """
    keys = keys or []
    rows = df.withColumns({"_a": F.coalesce(F.col(factor).cast("double"), F.lit(1.0)), "_b": F.coalesce(F.col(term).cast("double"), F.lit(0.0)), "_block": F.floor(F.col(at) / block).cast("long")})
    rows = Scratch(df.sparkSession).save(rows)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def walk(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
        out = np.empty(len(a))
        for i in range(len(a)):
            x = a[i] * x + b[i]
            out[i] = x
        return out

    def as_map(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(at)
        return group[[*keys, "_block"]].head(1).assign(_p=float(np.prod(g["_a"])), _q=walk(g["_a"].to_numpy(), g["_b"].to_numpy(), 0.0)[-1])

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "_block"])
    maps = rows.select(*keys, "_block", at, "_a", "_b").groupBy(*keys, "_block").applyInPandas(as_map, fields + ", _p double, _q double")

    def chain(group: pd.DataFrame) -> pd.DataFrame:  # one row a block
        g = group.sort_values("_block")
        ends = walk(g["_p"].to_numpy(), g["_q"].to_numpy(), start)
        return g[[*keys, "_block"]].assign(_x=np.concatenate([[start], ends[:-1]]))

    begun = maps.withColumn("_all", F.lit(0)).groupBy(*keys, "_all").applyInPandas(chain, fields + ", _x double")
    begun = Scratch(df.sparkSession).save(begun)

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(at)
        return g[[*keys, at]].assign(**{name: walk(g["_a"].to_numpy(), g["_b"].to_numpy(), float(g["_x"].iloc[0]))})

    place = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, at])
    filled = rows.select(*keys, "_block", at, "_a", "_b").join(begun, [*keys, "_block"]).groupBy(*keys, "_block").applyInPandas(fill, f"{place}, `{name}` double")
    return df.join(filled, [*keys, at])


def ranked(df: DataFrame, column: str, name: str = "rank", keys: list[str] | None = None, pieces: int | None = None) -> DataFrame:
    """Adds the rank of a column from 1, equal values sharing their mean rank; null has none.

    Values are counted first, so that equal ones are one row when they are put in order.
    """
    keys = keys or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    placed = running(positions(counts, [column], keys, "_at", pieces), {"_upto": ("sum", "_n")}, keys, "_at")
    placed = placed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(column).alias("_v"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    on = F.col(column) == F.col("_v")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(placed, on, "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, column: str, points: dict[str, float], keys: list[str] | None = None, pieces: int | None = None) -> DataFrame:
    """keys, n and one column for each name -> share of ``points``: exact quantiles, linear between neighbours, of each group, all in one pass.

    Values are counted and put in order over all groups together, so no group's values meet in one task; null values are left out.
    """
    keys = keys or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    placed = running(positions(counts, [column], keys, "_at", pieces), {"_upto": ("sum", "_n")}, keys, "_at")
    placed = Scratch(df.sparkSession).save(placed)
    sizes = placed.groupBy(*keys).agg(F.sum("_n").alias("n"))
    rows = placed.join(sizes, keys) if keys else placed.join(F.broadcast(sizes))
    at = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in points.items()}
    ends = [F.min(F.when(F.col("_upto") > f(c), F.col(column))).alias(f"_{side}_{name}") for name, c in at.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = rows.groupBy(*keys, "n").agg(*ends)
    between = [(F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (c - F.floor(c))).alias(name) for name, c in at.items()]
    return found.select(*keys, "n", *between)


def groups_of(df: DataFrame, order: list[str], k: int, name: str) -> DataFrame:
    """Adds ``name``: 0 to k - 1, groups of equal size in the given order, the first ones one larger where it does not divide."""
    n = df.count()
    q, r = divmod(n, k)
    at = F.col("_at")
    group = F.when(at < (q + 1) * r, F.floor(at / (q + 1))).otherwise(r + F.floor((at - r * (q + 1)) / max(q, 1)))
    return positions(df, order, name="_at").withColumn(name, group.cast("int")).drop("_at")
