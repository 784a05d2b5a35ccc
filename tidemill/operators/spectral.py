"""Standardising, principal components, diffusion coordinates, silhouettes and neighbours.

All rows are compared with all in tiles of bounded size; no task and not the driver holds an N x N matrix,
and nothing is taken from a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import eigen, lloyd
from .tiles import BLOCK, CHUNK, GROUP, Rough, Side, Tiles, added, apart, apart_at, over, tiles


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns centred and divided by their population deviation (1 where that is 0). One aggregate row is broadcast."""
    stats = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_s{i}"))])
    out = df.join(F.broadcast(stats))
    z = {c: (F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i, c in enumerate(columns)}
    return out.withColumns(z).select(*df.columns)


def standardize_vectors(df: DataFrame, column: str = "x") -> DataFrame:
    """The same for an array column: one group-by on positions, then arithmetic by position."""
    each = df.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_pop(F.col("v").cast("double")).alias("s"))
    stats = each.agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("e")).select(F.col("e.m").alias("_m"), F.col("e.s").alias("_s"))  # one row of positions
    z = F.transform(column, lambda v, i: (v.cast("double") - F.get("_m", i)) / F.when(F.get("_s", i) > 0, F.get("_s", i)).otherwise(1.0))
    return df.join(F.broadcast(stats)).withColumn(column, z).drop("_m", "_s")


def principal_components(df: DataFrame, column: str = "x", k: int = 50) -> DataFrame:
    """The array column in its first k principal components, if it has more than k entries. Signs are free; distances are not."""
    n = df.select(F.size(column).alias("n")).first()
    if n is None or n["n"] <= k:
        return df
    # written, as the fit reads its rows several times
    v = Scratch(df.sparkSession).save(df).withColumn("_v", array_to_vector(F.col(column)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn(column, vector_to_array("_p")).drop("_v", "_p")


def diffusion_coordinates(df: DataFrame, key: str, column: str = "x", count: int = 20, method: str = "markov", tol: float = 1e-9) -> tuple[DataFrame, np.ndarray]:
    """(key, dc) with dc[k] = eigenvalue k times eigenvector k (after the first), and the eigenvalues, over all rows.

    The bandwidth is the square of the lower median of positive distances. ``markov``: right eigenvectors of P = K / row sums, by the symmetric
    D^-1/2 K D^-1/2. ``lower_triangle``: eigenvectors of the symmetric matrix that has P's lower triangle in order of keys.
    Keys are whole numbers; rows without a vector go.
    """
    t = tiles(df, key, column)
    if t.n < 3:
        return df.where(F.col(column).isNotNull()).select(key, F.array().cast("array<double>").alias("dc")), np.zeros(0)
    values, vectors = eigen.leading(t, _summary(t).eps or 1.0, count, method, tol)
    times = F.array(*[F.lit(float(v)) for v in values])
    kind = df.schema[key].dataType
    return vectors.select(F.col("k").cast(kind).alias(key), F.zip_with("v", times, lambda v, w: v * w).alias("dc")), values


def eigenvalue_ratios(spark, values: np.ndarray, first: int = 12) -> DataFrame:
    """(k, eigenvalue, ratio to the next) for the first eigenvalues."""
    v = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(values[:first])], "k int, eigenvalue double")
    return v.withColumn("ratio", F.col("eigenvalue") / F.lead("eigenvalue").over(Window.partitionBy(F.lit(0)).orderBy("k")))


def silhouette(df: DataFrame, key: str, column: str, label: str, size: int = BLOCK) -> DataFrame:
    """One row ``silhouette``: mean of (b - a) / max(a, b) with plain Euclidean distances, over all rows against all rows.

    Rows without a label belong to no cluster and count 0.
    """
    return df.sparkSession.createDataFrame([(silhouettes(df, key, column, {None: label}, size)[0],)], "silhouette double")


def silhouettes(df: DataFrame, key: str, column: str, labels: dict[int | None, str], size: int = BLOCK) -> list[float | None]:
    """The silhouette of each column of labels in the first so many numbers of the vector (None: all), in one pass over all pairs.

    A tile adds the distances of its rows to each cluster, and its sums are added by block. There is one row a cluster on the driver.
    """
    dims = sorted(labels, key=lambda d: (d is None, d))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(labels[d]).cast("double").alias("l")) for i, d in enumerate(dims)])).alias("e")
    found = df.where(F.col(column).isNotNull()).select(each).select("e.*").where("l is not null").groupBy("i", "l").agg(F.count("*").alias("n")).orderBy("i", "l").collect()
    names = [np.array([r.l for r in found if r.i == i]) for i in range(len(dims))]
    held = [np.array([r.n for r in found if r.i == i], float) for i in range(len(dims))]
    ends = np.cumsum([0, *map(len, names)])
    spans = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    t = tiles(df, key, column, size, min(GROUP, max(size, WIDEST // max(1, int(ends[-1])))), **{f"l{i}": F.col(labels[d]) for i, d in enumerate(dims)})
    if not t.n:
        return [None for _ in labels]

    def distances(a: Side, b: Side, same: bool) -> Iterator[tuple[slice, slice, int, np.ndarray]]:
        r = Rough(a["x"], b["x"])
        if dims == [None]:
            for rows, cols, d in r.pieces(same):
                close = np.flatnonzero(d <= 1e6 * r.slack)
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                d.ravel()[close] = r.exact(rows, cols, close)
                yield rows, cols, 0, d
            return
        for rows, cols in r.places(same):
            x, y, done = r.x[rows], r.y[cols], 0
            total = np.zeros((len(x), len(y)))
            for i, d in enumerate(dims):
                for k in range(done, x.shape[1] if d is None else min(d, x.shape[1])):
                    v = x[:, k, None] - y[None, :, k]
                    total += np.multiply(v, v, out=v)
                    done = k + 1
                yield rows, cols, i, np.sqrt(total)

    def sums(a: Side, b: Side, same: bool) -> Iterator[dict]:
        sides = (a,) if same else (a, b)
        hot = [[(s[f"l{i}"] == names[i]).astype(float) for i in range(len(dims))] for s in sides]
        y = [np.zeros((len(s.k), ends[-1])) for s in sides]
        for rows, cols, i, d in distances(a, b, same):
            y[0][rows, spans[i]] += d @ hot[-1][i][cols]
            if not same or rows != cols:
                y[-1][cols, spans[i]] += d.T @ hot[0][i][rows]
        for s, total in zip(sides, y, strict=True):
            yield {"b": s.blocks, "y": [total[rows].ravel() for rows in s.slices]}

    def values(row: pd.Series, total: np.ndarray) -> dict:
        total, out = total.reshape(len(row["k"]), -1), []
        for i, span in enumerate(spans):
            part, own = total[:, span], np.asarray(row[f"l{i}"], float)[:, None] == names[i]
            n = np.where(own, held[i] - 1, held[i])
            mean = part / np.where(n > 0, n, np.nan)
            a = np.where(own, mean, 0.0).sum(1)
            b = np.where(own, np.inf, mean).min(1, initial=np.inf)
            most = np.maximum(a, b)
            good = own.any(1) & np.isfinite(most) & (most > 0)
            out.append(((b - a)[good] / most[good]).sum())
        return {"s": out}

    s = eigen._sums(added(t, over(t, sums, "b int, y array<double>"), values, "s array<double>"), lambda row: np.asarray(row.s), len(dims)) / t.n
    at = {d: float(v) for d, v in zip(dims, s, strict=True)}
    return [at[d] for d in labels]


def silhouette_estimate(df: DataFrame, key: str, column: str, label: str, most: int = 2000, delta: float = 0.05, seed: int = 42) -> DataFrame:
    """One row (silhouette, bound): a stratified estimate that is within ``bound`` of the exact value with probability 1 - delta.

    In each cluster a share of ``most`` rows, two at least, is chosen by a hash of the key; their silhouettes are exact, against all rows, in one
    pass of N x most distances. The bound is Hoeffding's for means of values in [-1, 1] of strata of known weights. Rows without a
    label count 0, as in ``silhouette``.
    """
    held = df.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("l"), F.col(column).cast("array<double>").alias("x"))
    sizes = {r.l: r.n for r in held.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row a cluster
    n, known = sum(sizes.values()), {c: m for c, m in sizes.items() if c is not None}
    if len(known) < 2:
        return df.sparkSession.createDataFrame([(0.0 if n else None, 0.0)], "silhouette double, bound double")
    share = {c: min(m, max(2, most * m // n)) for c, m in known.items()}
    quota = F.create_map(*[v for c, m in share.items() for v in (F.lit(c), F.lit(m))])
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64(F.lit(seed), "k"), "k"))
    asked = held.where("l is not null").withColumn("place", place).where(F.col("place") <= max(share.values())).where(F.col("place") <= quota[F.col("l")]).collect()
    keys, x, own = np.array([r.k for r in asked]), np.array([r.x for r in asked], float), np.array([r.l for r in asked])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            y, labels = np.array(b["x"].tolist(), float).reshape(len(b), -1), b["l"].to_numpy()
            for i in range(0, len(b), BLOCK):
                d = apart(x, y[i : i + BLOCK])
                for c in np.unique(labels[i : i + BLOCK]):
                    total[c] = total.get(c, 0) + d[:, labels[i : i + BLOCK] == c].sum(1)
        for c, t in total.items():
            yield pd.DataFrame({"q": np.arange(len(t)), "cluster": c, "total": t})

    clusters, far = sorted(known), np.zeros((len(known), len(asked)))
    for r in held.where("l is not null").mapInPandas(sums, "q int, cluster int, total double").groupBy("q", "cluster").agg(F.sum("total").alias("t")).collect():
        far[clusters.index(r["cluster"]), r["q"]] = r["t"]
    m = np.array([known[c] for c in clusters])
    mine = np.array([clusters.index(c) for c in own])
    at = np.arange(len(asked))
    a = far[mine, at] / np.maximum(m[mine] - 1, 1)
    other = far / m[:, None]
    other[mine, at] = np.inf
    b = other.min(0)
    value = np.where(m[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    weight = m / n
    mean = sum(w * value[mine == i].mean() for i, w in enumerate(weight))
    drawn = np.array([(mine == i).sum() for i in range(len(clusters))])
    spread = sum(w * w / k for w, k, c in zip(weight, drawn, m, strict=True) if k < c)
    return df.sparkSession.createDataFrame([(float(mean), float(np.sqrt(2 * np.log(2 / delta) * spread)))], "silhouette double, bound double")


def k_means(coords: DataFrame, d: int, k: int, seeds: int = 5, seed: int = 42, key: str = "window_id") -> DataFrame:
    """coords with ``x``, the first d of ``dc``, and ``label``: the best of ``seeds`` runs of k-means."""
    at = lloyd.fitted(tiles(coords, key, "dc").rows, [d], k, seeds, seed)[d]
    return lloyd.labelled(coords, "dc", {"label": at}).withColumn("x", F.slice("dc", 1, d))


def clusters_for(n: int) -> int:
    return max(2, min(10, n // 50))


def choose_dimension(coords: DataFrame, key: str, dims: range = range(2, 21), seeds: int = 5, seed: int = 42, exact: bool = True) -> DataFrame:
    """(d, silhouette, bound) for each dimension: of the best of ``seeds`` k-means runs into max(2, min(10, N // 50)) clusters; order by silhouette to choose.

    All dimensions share one pass over all pairs. Not ``exact``, it is ``silhouette_estimate`` with its bound, which takes no N x N pass; else the bound is 0.
    """
    s = Scratch(coords.sparkSession)
    coords = s.save(coords)
    k, dims = clusters_for(coords.count()), list(dims)
    at = lloyd.fitted(tiles(coords, key, "dc").rows, dims, k, seeds, seed)
    x = s.save(lloyd.labelled(coords, "dc", {f"label{d}": at[d] for d in dims}).withColumn("x", F.slice("dc", 1, max(dims, default=1))))
    if exact:
        found = [(v, 0.0) for v in silhouettes(x, key, "x", {d: f"label{d}" for d in dims})] if dims else []
    else:
        found = [tuple(silhouette_estimate(x.withColumn("x", F.slice("x", 1, d)), key, "x", f"label{d}").first()) for d in dims]
    return coords.sparkSession.createDataFrame([(d, *v) for d, v in zip(dims, found, strict=True)], "d int, silhouette double, bound double")


def pair_summary(df: DataFrame, key: str, column: str = "x", size: int = BLOCK, bins: int = 4096) -> DataFrame:
    """One row: n, least and most of the positive distances of all unordered pairs, and eps, the square of their lower median.

    The median is exact: each pass counts the distances of the range that holds it in ``bins``
    bins, and the bin with the median, from its least to its largest value, is the next range, until these are
    equal. A pass gives at most ``bins`` rows; no pair is a row.
    """
    return df.sparkSession.createDataFrame([tuple(_summary(tiles(df, key, column, size), bins))], "n long, least double, most double, eps double")


#: Numbers of rows times clusters of a group, at most.
WIDEST = 16_000_000
#: Positive numbers by their leading bits: 2 ** 14 bins an octave.
BITS = 38
#: So many pairs of the median's bin, at most, are written by value; above, they are counted in bins again.
WRITTEN = 30_000_000


#: So many values of a tile, at most, wait to be counted together.
APART = 1 << 20


class Tally:
    """How often each whole number came: one array over the range of the numbers, however many pieces they come in (of doubles by their leading bits, 33 million numbers at most)."""

    def __init__(self):
        self.base, self.n = 0, np.zeros(0, np.int64)

    def add(self, at: np.ndarray) -> None:
        start = int(at.min())
        n = np.bincount(at - start)
        low, high = (min(self.base, start), max(self.base + len(self.n), start + len(n))) if len(self.n) else (start, start + len(n))
        if high - low > len(self.n):
            wide = np.zeros(high - low, np.int64)
            if len(self.n):
                wide[self.base - low :][: len(self.n)] = self.n
            self.base, self.n = low, wide
        self.n[start - self.base :][: len(n)] += n

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.n)
        return at + self.base, self.n[at]


def _merged(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Parts of (name, n, low, high) as one, sorted, with a row a name."""
    name, n, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(name, kind="stable")
    name, begin = np.unique(name[order], return_index=True)
    return name, np.add.reduceat(n[order], begin), np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin)


def _summary(t: Tiles, bins: int = 4096, written: int = WRITTEN) -> Row:
    def first(a: Side, b: Side, same: bool) -> Iterator[dict]:
        """Pairs by the leading bits of their rough squares, pairs of equal rows as bin -1; the least and greatest distance by differences."""
        r = Rough(a["x"], b["x"], np.float32)
        tally, equal, least, most = Tally(), 0, np.inf, 0.0
        for rows, cols, s in r.pieces(same):
            if same and rows == cols:
                s[np.tril_indices(len(s))] = -np.inf
            flat = s.ravel()
            close = np.flatnonzero((flat <= 2 * r.slack) & (flat > -np.inf))
            if len(close):
                d = r.exact(rows, cols, close)
                equal += int((d == 0).sum())
                flat[close] = np.where(d > 0, np.minimum(d * d, 2 * r.slack), -np.inf)
                least = min(least, d[d > 0].min(initial=np.inf))
                most = max(most, d.max(initial=0.0))
            v = flat[flat > -np.inf] if len(close) or same and rows == cols or not r.safe else flat
            if not len(v):
                continue
            low, high = float(v.min()), float(v.max())
            if low > 2 * r.slack and low - 2 * r.slack < least * least:
                least = min(least, r.exact(rows, cols, np.flatnonzero((flat > -np.inf) & (flat <= low + 2 * r.slack))).min())
            if high + 2 * r.slack > most * most:
                most = max(most, r.exact(rows, cols, np.flatnonzero(flat >= high - 2 * r.slack)).max())
            tally.add(np.maximum(v.astype(np.float64), 0.0).view(np.int64) >> BITS)
        names, counts = tally.found()
        yield {"bin": np.append(names, -1), "n": np.append(counts, equal), "low": least, "high": most, "slack": r.slack}

    each = over(t, first, "bin long, n long, low double, high double, slack double", ["x"])
    whole = each.groupBy("bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("slack").alias("slack")).orderBy("bin").collect()
    n = sum(r.n for r in whole if r.bin >= 0)
    if not n:
        return Row(n=0, least=None, most=None, eps=None)
    least, most, slack = min(r.low for r in whole), max(r.high for r in whole), max(r.slack for r in whole)
    rank = (n + 1) // 2 + sum(r.n for r in whole if r.bin < 0)  # among all pairs, those of equal rows too
    before = 0
    for r in whole:
        before += r.n
        if before >= rank:
            break
    edges = np.array([r.bin << BITS, (r.bin + 1) << BITS]).view(np.float64)
    low = max(least, float(np.sqrt(max(0.0, edges[0] - slack))) * (1 - 1e-12))
    high = min(most, float(np.sqrt(edges[1] + slack)) * (1 + 1e-12))

    def inside(low: float, high: float, whole: bool) -> DataFrame:
        """Distances by differences from low to high, by value or in bins, and as bin -1 the number of pairs below."""

        def binned(v: np.ndarray) -> np.ndarray:
            return np.minimum(((v - low) / (high - low) * bins).astype(int), bins - 1)

        def count(a: Side, b: Side, same: bool) -> Iterator[dict]:
            r = Rough(a["x"], b["x"], np.float32)
            below, held, waiting = 0, [tuple(np.array([x]) for x in (-1.0, 0, 0.0, 0.0))], 0
            for rows, cols, s in r.pieces(same):
                if same and rows == cols:
                    s[np.tril_indices(len(s))] = np.inf
                flat = s.ravel()
                sure = flat < low * low - 2 * r.slack
                d = r.exact(rows, cols, np.flatnonzero(~sure & (flat <= high * high + 2 * r.slack)))
                below += int(sure.sum()) + int((d < low).sum())
                v = d[(d >= low) & (d <= high)]
                held.append((v if whole else binned(v).astype(float), np.ones(len(v), int), v, v))
                waiting += len(v)
                if waiting > APART:
                    held, waiting = [_merged(held)], 0
            _, n, least, most = _merged(held)
            n[0] += below
            yield {"bin": [-1, *binned(least[1:])], "n": n, "low": least, "high": most}

        return over(t, count, "bin int, n long, low double, high double", ["x"])

    held, many = None, r.n
    while low < high:
        if held is None:
            each = inside(low, high, many <= written)
            if many <= written:
                each = held = t.scratch.save(each)
            left = rank
        else:
            each = held.where((F.col("low") >= low) & (F.col("high") <= high)).withColumn("bin", F.least(((F.col("low") - low) / (high - low) * bins).cast("int"), F.lit(bins - 1)))
        for r in each.groupBy("bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("bin").collect():
            if left <= r.n:
                break
            left -= r.n
        low, high, many = r.low, r.high, r.n
    return Row(n=n, least=least, most=most, eps=low * low)


def kernel_degrees(df: DataFrame, key: str, column: str, eps: float, size: int = BLOCK) -> DataFrame:
    """(i, degree, diagonal): sum and largest value of each row of the Gaussian kernel over all rows, added up by tiles."""

    def sums(a: Side, b: Side, same: bool) -> Iterator[dict]:
        r = Rough(a["x"], b["x"])
        s, m = zip(*((np.zeros(len(x.k)), np.zeros(len(x.k))) for x in (a, b)), strict=True)
        for rows, cols, d in r.pieces(same):
            if same and rows == cols:
                np.fill_diagonal(d, 0.0)
            np.maximum(d, 0, out=d)
            d *= -1 / eps
            k = np.exp(d, out=d)
            for side, at, axis in ((0, rows, 1), (0 if same else 1, cols, 0))[: 1 if same and rows == cols else 2]:
                s[side][at] += k.sum(axis)
                m[side][at] = np.maximum(m[side][at], k.max(axis))
        for x, total, most in ((a, s[0], m[0]), (b, s[1], m[1]))[: 1 if same else 2]:
            yield {"i": x.k, "s": total, "m": most}

    return over(tiles(df, key, column, size), sums, "i long, s double, m double", ["x"]).groupBy("i").agg(F.sum("s").alias("degree"), F.max("m").alias("diagonal"))


def neighbours(df: DataFrame, key: str, column: str = "x", k: int = 20, size: int = BLOCK, bandwidth: float | None = None) -> DataFrame:
    """(i, j, dist, rank) of the k nearest other rows of each row, ties by j, and with ``bandwidth`` a Gaussian density sum as ``kde``.

    The exact way: each tile gives k candidates a row, and the k best of all tiles are kept. ``operators.knn`` has the way by an index.
    """

    def nearest(a: Side, b: Side, same: bool) -> Iterator[dict]:
        for one, two in ((a, b),) if same else ((a, b), (b, a)):
            r, whole = Rough(one["x"], two["x"], np.float64 if bandwidth else np.float32), slice(0, len(two.k))
            for i in range(0, len(one.k), CHUNK):
                rows = slice(i, min(i + CHUNK, len(one.k)))
                s = r(rows, whole)
                kde = np.exp(np.maximum(s, 0) / (-2 * bandwidth**2)).sum(1) if bandwidth else np.zeros(len(s))
                yield {"i": one.k[rows], "kde": kde} | nearest_of(r, one.k, two.k, rows, s, k)

    each = over(tiles(df, key, column, size), nearest, "i long, dist array<double>, j array<bigint>, kde double", ["x"])
    best = each.select("i", "kde", F.arrays_zip("dist", "j").alias("near")).groupBy("i").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"), F.sum("kde").alias("kde"))
    return best.select("i", "kde", F.posexplode("near").alias("rank", "n")).select("i", F.col("n.j").alias("j"), F.col("n.dist").alias("dist"), (F.col("rank") + 1).alias("rank"), "kde")


def nearest_of(r: Rough, own: np.ndarray | None, keys: np.ndarray, rows: slice, s: np.ndarray, k: int, most: np.ndarray | None = None) -> dict:
    """Lists ``dist`` and ``j`` of the k nearest other keys of some rows, ties by key, from the rough squares s of these rows to all of ``keys``; where these are infinite, the pair is left out. Without ``own`` keys a row is near itself.

    The k + 1 smallest rough squares of some columns bound the k-th distance to others, or ``most``, a bound of its square that is known; what is below that is compared by differences.
    """
    if most is None:
        part = s[:, : max(4 * (k + 1), s.shape[1] // 4)]
        bound = np.partition(part, k, axis=1)[:, k] if part.shape[1] > k else np.full(len(s), np.inf)
    else:
        bound = most.astype(float)
    open_ = np.flatnonzero(~np.isfinite(bound))
    if len(open_) and s.shape[1] > k:
        bound[open_] = np.partition(s[open_], k, axis=1)[:, k]
    i, j = np.nonzero((s <= (bound + 4 * r.slack)[:, None]) & (s < np.inf))
    if own is not None:
        other = own[rows][i] != keys[j]
        i, j = i[other], j[other]
    d = apart_at(r.x, r.y, i + rows.start, j)
    i, j, d = (v[np.isfinite(d)] for v in (i, keys[j], d))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    i, j, d = i[kept], j[kept], d[kept]
    at = np.searchsorted(i, np.arange(1, len(s)))
    return {"dist": np.split(d, at), "j": np.split(j, at)}


def best_of(d: np.ndarray, keys: np.ndarray, k: int) -> list[list[dict]]:
    """The k smallest finite distances of each row, ties by key, as lists of structs."""
    if d.shape[1] > 4 * k:  # all that ties with the k-th stays for the sort
        bound = np.partition(d, k - 1, axis=1)[:, k - 1]
        cut = [np.flatnonzero(row <= b) for row, b in zip(d, bound, strict=True)]
    else:
        cut = [np.arange(d.shape[1])] * len(d)
    out = []
    for row, at in zip(d, cut, strict=True):
        at = at[np.lexsort((keys[at], row[at]))[:k]]
        out.append([{"dist": float(row[j]), "j": int(keys[j])} for j in at if np.isfinite(row[j])])
    return out
