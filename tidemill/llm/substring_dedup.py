"""Near-duplicate passages across documents, by compact windows of min-hash signatures.

A document is its row of word shingles (five words). Two functions rank the shingles. The
Cartesian tree of a row's ranks gives, for each shingle, the compact window in
which it is the least; cut at runs of RUN shingles, the windows of both functions
are intervals of run starts, and their joins are cells: groups of runs that share a
signature (both least shingles and their distance). A cell is one row, however
many runs it stands for, about 0.16 a word.

No passage is missed: a window of T shingles (MIN_WORDS words) at similarity 0.8 lacks at most
MISSES shingles, and a change of words inside it breaks WIDTH - 1 shingles at least, so it has one such gap at
most and RUN consecutive shingles stand in the other document as they are: both documents have
that run's signature, at the same distance from its least shingles. (The exception: texts that repeat
themselves within SHIFT words, where a shift may break no shingle.)

Signatures of two texts or more are buckets. In a bucket each item, a text and its anchor, is
compared with one representative; items that are not verified with it try
another, and after ROUNDS rounds ``rest`` finds by an exact prefix filter all pairs of
the bucket that may still join two classes. A comparison is made on the shingles around the
diagonal of two anchors: windows of T shingles, SIMILARITY of them found in the other text within
SHIFT places of the diagonal. Verified windows are the passages, and link their texts.

Words that repeat exactly are counted apart from links, all of them: every window of T shingles has
its least shingle as anchor, and holds the HALF shingles before it or HALF + 2 after it. Anchors that share
such a side are grouped by all that their windows cover; equal contents repeat whole, and of each other
content one item's windows are compared one by one, by 64-bit hashes. No pairs are made. So a word in an exact
window of MIN_WORDS words that another text holds is in a passage, also in texts that repeat themselves.

Classes are exact, and a row has a passage if it has any. Which words of edited windows are in passages is
told by the pairs that were compared, of which there are few a text: such passages may be
longer where texts of one class share still other edited words with each other.

Exact copies are one text from the start: all words of a copied text that is long
enough are repeated, and it is in a class with its copies. Texts are told apart by 64 bits of
their MD5 in buckets, by all 128 elsewhere. Nulls, empty texts and texts of fewer than
MIN_WORDS words have no passage: n_dup_words 0, class_id the own doc_id. class_id is the
smallest doc_id of a connected component (null only if all are). Repeats inside one
document do not count. Repeated rows count as copies; other columns of docs are not
read. Very long texts are compared in segments of SEGMENT shingles, only where they have a
bucket. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bodies, components, extended, text_key
from .shingles import GOLDEN, WordHashes, mix, shingles, shingles_of, word_hashes

WIDTH, MIN_WORDS, SIMILARITY, SHIFT, CHUNK = 5, 50, 0.8, 8, 200_000
T = MIN_WORDS - WIDTH + 1  # shingles in a window of MIN_WORDS words
NEED = math.ceil(2 * T * SIMILARITY / (1 + SIMILARITY))  # shingles that two similar windows share
MISSES = T - NEED  # fewer than two gaps of WIDTH - 1 shingles
RUN = -(-NEED // 2)  # consecutive shingles on one side of the only gap
REACH = T - 1  # a window that holds an anchor reaches so far
HALF = T // 2 - 1  # a window of T shingles holds so many before its anchor, or HALF + 2 after it
SEGMENT, PAD, ROUNDS, BLOCK, BATCH = 512, REACH + SHIFT, 3, 64, 5
SALT = np.uint64(0xA0761D6478BD642F)
INVERSE = np.uint64(pow(int(GOLDEN), -1, 2**64))


def sliding(x: np.ndarray, t: int, least: bool = True) -> np.ndarray:
    """Minimum (maximum) of each window of t values (len(x) >= t): a suffix of one block and a prefix of the next."""
    op, n = np.minimum if least else np.maximum, len(x)
    padded = np.full(-(-n // t) * t, np.iinfo(np.uint64).max if least else 0, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, t)
    prefix = op.accumulate(blocks, 1).ravel()
    suffix = op.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return op(suffix[: n - t + 1], prefix[t - 1 : n])


def compact_windows(x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(first start, anchor): from each first start to the next, the runs of t values of x have their least value at the anchor (the leftmost on ties).

    Only anchors, the least values of some run, are nodes of the tree: the nearest smaller value on
    either side of an anchor whose window has t values is the least of the run that ends or begins there.
    """
    wide = np.pad(sliding(x, t), t - 1)
    c = np.flatnonzero(sliding(wide, t, least=False) == x)
    v, n = x[c], len(c)
    left, right, at = np.arange(n) - 1, np.arange(n) + 1, np.arange(n)
    while len(at):  # up to t steps, as a window is cut at t - 1 places from its anchor
        at = at[left[at] >= 0]
        at = at[(v[left[at]] > v[at]) & (c[left[at]] > c[at] - t)]
        left[at] -= 1
    at = np.arange(n)
    while len(at):
        at = at[right[at] < n]
        at = at[(v[right[at]] >= v[at]) & (c[right[at]] < c[at] + t)]
        right[at] += 1
    first = np.maximum(np.where(left >= 0, c[left] + 1, 0), c - t + 1)
    last = np.minimum(c, np.where(right < n, c[np.minimum(right, n - 1)], len(x)) - t)
    some = first <= last
    return first[some], c[some]


def cells(x: np.ndarray, doc: np.ndarray, t: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, signature, anchor of the first function) of each cell of the shingles x, whose documents are numbered by doc, in order."""
    if len(x) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        ranks = [mix(x), mix(x ^ SALT)]
        tiles = [compact_windows(r, t) for r in ranks]
        starts = np.unique(np.concatenate([tiles[0][0], tiles[1][0], np.flatnonzero(np.diff(doc, prepend=-1))]))
        starts = starts[starts <= len(x) - t]
        starts = starts[doc[starts] == doc[starts + t - 1]]
        a, b = (anchor[np.searchsorted(first, starts, "right") - 1] for first, anchor in tiles)
        key = mix(mix(ranks[0][a]) * GOLDEN + ranks[1][b] + (b - a).astype(np.uint64))
    # a text that repeats itself all the time ("no no no") has one cell for the whole stretch
    in_order = np.sort(key)
    twice = np.flatnonzero(np.isin(key, in_order[1:][in_order[1:] == in_order[:-1]]))
    order = twice[np.lexsort((starts[twice], key[twice], doc[starts[twice]]))]
    ahead = np.diff(starts[order], prepend=-t) < t
    again = order[1:][(key[order][1:] == key[order][:-1]) & (doc[starts][order][1:] == doc[starts][order][:-1]) & ahead[1:]]
    keep = np.ones(len(starts), bool)
    keep[again] = False
    return doc[starts][keep], key[keep], a[keep]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    with np.errstate(over="ignore"):
        return [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b)])) for b in (GOLDEN, INVERSE)]


POWERS = _powers(SEGMENT)


class Stretches:
    """Hashes of stretches of x: a polynomial modulo 2^64 whose differences of prefixes are moved to place 0."""

    def __init__(self, x: np.ndarray):
        with np.errstate(over="ignore"):
            powers, self.back = (p[: len(x) + 1] for p in (POWERS if len(x) <= SEGMENT else _powers(len(x))))
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(mix(x) * powers[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[stop] - self.total[start]) * self.back[start] + (stop - start).astype(np.uint64))


def anchored(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, key of the side, hash of the content, anchor, first and last start) of the windows of T shingles of x, by anchors and the side they hold."""
    if len(x) < T:
        return tuple(np.zeros(0, k) for k in (int, np.uint64, np.uint64, int, int, int))
    first, anchor = compact_windows(mix(x), T)
    starts = np.unique(np.concatenate([first, np.flatnonzero(np.diff(doc, prepend=-1))]))
    ends = np.searchsorted(doc, doc[starts], "right") - T
    stops = np.minimum(np.append(starts[1:] - 1, len(x)), ends)
    some = starts <= stops
    starts, stops = starts[some], stops[some]
    a = anchor[np.searchsorted(first, starts, "right") - 1]
    hashes, out = Stretches(x), []
    for lo, hi, begin, end, salt in ((starts, np.minimum(stops, a - HALF), a - HALF, a + 1, np.uint64(0)), (np.maximum(starts, a - HALF + 1), stops, a, a + HALF + 3, SALT)):
        k = np.flatnonzero(lo <= hi)
        out.append((doc[lo[k]], hashes.of(begin[k], end[k]) ^ salt, hashes.of(lo[k], hi[k] + T), a[k], lo[k], hi[k]))
    out = [np.concatenate(c) for c in zip(*out)]
    order = np.argsort(out[0], kind="stable")
    return tuple(c[order] for c in out)


def _runs(texts) -> Iterator[list[int]]:
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "") // 5
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def cell_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells and windows of each text; BATCH runs of texts share a number."""
    words, task, n = WordHashes(), TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for run in _runs(batch["text"].tolist()):
            part = batch.iloc[run]
            hashes, at = word_hashes(part["text"].tolist(), words)
            x, offsets = shingles_of(hashes, at, MIN_WORDS, WIDTH)
            doc = np.repeat(np.arange(len(part)), np.diff(offsets))
            d, k, a = cells(x, doc)
            k, a = k.view(np.int64), (a - offsets[d]).astype(np.int32)
            cut = np.searchsorted(d, np.arange(1, len(part)))
            out = {"doc_id": part["doc_id"].astype("Int64"), "key": part["key"].to_numpy(), "batch": task + n // BATCH, "n_words": np.diff(at), "bkeys": np.split(k, cut), "anchors": np.split(a, cut)}
            d, e, h, c, lo, hi = anchored(x, doc)
            cut = np.searchsorted(d, np.arange(1, len(part)))
            parts = {"ekeys": e.view(np.int64), "contents": h.view(np.int64), "places": (c - offsets[d]).astype(np.int32), "los": (lo - c).astype(np.int8), "his": (hi - c).astype(np.int8)}
            yield pd.DataFrame(out | {name: np.split(v, cut) for name, v in parts.items()})
            n += 1


def _lists(values: np.ndarray, at: np.ndarray) -> pd.Series:
    """The values cut at the places at, of which the first is 0, if any."""
    return pd.Series(np.split(values, at[1:]) if len(at) else [], dtype=object)


def _joined(arrays: pd.Series, dtype: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *arrays])


def _extremes(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order of the keys, first place of each different one in it, least lo and largest hi of each."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), np.diff(keys[order]) != 0]))
    return (order, first, np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first)) if len(keys) else (order, first, lo, hi)


def key_packs(parts: int):
    """Packs of (key, batch), once each, with the least and the largest node; pack p holds a range of the signatures, pack parts + p of the sides of anchors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for batch, texts in frame.groupby("batch"):
                for k, name in enumerate(("bkeys", "ekeys")):
                    keys, nodes = _joined(texts[name]), np.repeat(texts["node"].to_numpy(), texts[name].map(len))
                    order, first, lo, hi = _extremes(keys, nodes, nodes)
                    keys = keys[order][first]
                    p = ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64) + k * parts
                    out.append((p, keys, lo, hi, np.full(len(p), batch)))
            if not out:
                continue
            p, *columns = (np.concatenate(c) for c in zip(*out, strict=True))
            order = np.argsort(p, kind="stable")
            some, at = np.unique(p[order], return_index=True)
            yield pd.DataFrame({"p": some} | {name: _lists(c[order], at) for name, c in zip(("keys", "los", "his", "batches"), columns, strict=True)})

    return rows


def repeated_keys(parts: int):
    """The keys of a pack that several nodes hold, by batch."""

    def rows(pack: pd.DataFrame) -> pd.DataFrame:
        keys, lo, hi, batch = (_joined(pack[c]) for c in ("keys", "los", "his", "batches"))
        order, first, least, most = _extremes(keys, lo, hi)
        kept = order[np.repeat(least < most, np.diff(np.append(first, len(keys))))]
        kept = kept[np.argsort(batch[kept], kind="stable")]
        some, at = np.unique(batch[kept], return_index=True)
        return pd.DataFrame({"batch": some, "exact": bool(pack["p"].iloc[0] >= parts), "keys": _lists(keys[kept], at)})

    return rows


def repeated_items(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The items of a batch of texts that hold a key of several nodes."""
    texts, out = texts.drop_duplicates("node"), []
    for exact, name, columns in ((False, "bkeys", {"c": "anchors"}), (True, "ekeys", {"c": "places", "content": "contents", "lo": "los", "hi": "his"})):
        keys, mine = np.sort(_joined(found["keys"][found["exact"] == exact])), _joined(texts[name])
        if len(keys) and len(mine):
            some = keys[np.minimum(np.searchsorted(keys, mine), len(keys) - 1)] == mine
            rows = {"exact": exact, "key": mine[some], "node": np.repeat(texts["node"].to_numpy(), texts[name].map(len))[some], "content": 0, "lo": 0, "hi": 0}
            out.append(pd.DataFrame(rows | {c: _joined(texts[v], np.int8)[some] for c, v in columns.items()}))
    return pd.concat(out)[ITEM] if out else pd.DataFrame(columns=ITEM)


ITEM = ["exact", "key", "node", "c", "content", "lo", "hi"]


def repeated(made: DataFrame) -> DataFrame:
    """(exact, key, node, c, content, lo, hi): the items of ``made`` whose signature, or side of an anchor, several texts hold.

    Keys go to packs, by ranges, once a batch of texts, however many of its texts have them; those of several texts go
    back to their batches. So only the items of such keys become rows, and a key of all texts is one number a batch.
    """
    parts = max(16, int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packs = made.select("batch", "node", "bkeys", "ekeys").mapInPandas(key_packs(parts), "p int, keys array<long>, los array<long>, his array<long>, batches array<long>")
    found = packs.groupBy("p").applyInPandas(repeated_keys(parts), "batch long, exact boolean, keys array<long>")
    texts = made.select("batch", "node", "bkeys", "anchors", "ekeys", "contents", "places", "los", "his")
    return texts.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(repeated_items, "exact boolean, key long, node long, c int, content long, lo tinyint, hi tinyint")


def window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash and start, counted from the anchor c, of each window of T shingles of an item of a segment x."""
    for batch in batches:
        rows = []
        for x, c, lo, hi in zip(batch["x"], batch["c"], batch["lo"], batch["hi"], strict=True):
            at = c % SEGMENT + PAD
            starts = np.arange(hi - lo + 1)
            rows.append((Stretches(x[at + lo : at + hi + T].view(np.uint32).astype(np.uint64)).of(starts, starts + T).view(np.int64), starts + lo))
        sizes = [len(w) for w, _ in rows]
        out = batch[["ekey", "content", "least", "most"]].loc[batch.index.repeat(sizes)].reset_index(drop=True)
        out["w"], out["at"] = (np.concatenate(v) for v in zip(*rows)) if rows else ([], [])
        yield out.astype({"w": "int64", "at": "int32"})


def segment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The segments qs of each text's shingles, with PAD more on either side, as 32-bit hashes; 0 where the text has none."""
    words, size = WordHashes(), SEGMENT + 2 * PAD
    for batch in batches:
        for run in _runs(batch["text"].tolist()):
            part = batch.iloc[run]
            rows = []
            x, offsets = shingles_of(*word_hashes(part["text"].tolist(), words), MIN_WORDS, WIDTH)
            x = ((x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)).view(np.int32)
            for node, lo, hi, qs in zip(part["node"], offsets[:-1], offsets[1:], part["qs"], strict=True):
                s = np.zeros(hi - lo + 2 * PAD, np.int32)
                s[PAD:-PAD] = x[lo:hi]
                rows += [(node, q, s[q * SEGMENT : q * SEGMENT + size]) for q in qs]
            yield pd.DataFrame(rows, columns=["node", "q", "x"])


#: Shifts from a diagonal, the smallest first.
SHIFTS = np.array(sorted(range(-SHIFT, SHIFT + 1), key=abs))
within = np.lib.stride_tricks.sliding_window_view


def near_windows(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By rows: hit: shingles of x found in y within SHIFT of the diagonal x - y = d; good: starts of windows of T shingles of x of which NEED stand in one window of T of y.

    Rows of x and y end with zeros, where a text has no shingle.
    """
    n = x.shape[1]
    across = np.zeros((len(x), n + 2 * SHIFT), x.dtype)
    for row, other, k in zip(across, y, d.tolist(), strict=True):
        lo, hi = max(0, -k - SHIFT), min(n, n - k + SHIFT)
        if lo < hi:
            row[lo + k + SHIFT : hi + k + SHIFT] = other[lo:hi]
    hit = np.zeros(x.shape, bool)
    for k in SHIFTS:
        hit |= across[:, SHIFT + k : SHIFT + k + n] == x
    hit &= x != 0
    total = np.zeros((len(x), n + 1), np.int32)
    np.cumsum(hit, 1, out=total[:, 1:])
    good = total[:, T:] - total[:, :-T] >= NEED
    # where places of y are shifted within a window, some may be out of its reach
    straight = across[:, SHIFT : SHIFT + n] == x
    shifted = np.zeros_like(total)
    np.cumsum(hit & ~straight, 1, out=shifted[:, 1:])
    for i in np.flatnonzero((good & (shifted[:, T:] > shifted[:, :-T])).any(1)):
        equal = (within(across[i], len(SHIFTS)) == x[i][:, None])[:, SHIFTS + SHIFT]
        _narrow(hit[i], good[i], total[i], SHIFTS[equal.argmax(1)])
    return hit, good


def _narrow(hit: np.ndarray, good: np.ndarray, total: np.ndarray, moved: np.ndarray) -> None:
    """Takes the windows from good of which fewer than NEED stand in one window of T, by the shift of each shingle."""
    turns = np.cumsum(np.concatenate([[0], np.diff(moved[hit]) != 0]))
    turn = np.zeros(len(total), int)
    turn[1:] = turns[np.maximum(total[1:] - 1, 0)]
    first = np.minimum(total[:-T], total[-1] - 1)  # the first shingle found at or after a start
    at = np.flatnonzero(good & (turn[T:] != turns[first]))
    if len(at):
        h, place = within(hit, T)[at], within(moved, T)[at] + np.arange(T)
        best = np.zeros(len(at), int)
        for k in range(-SHIFT, SHIFT + 1):
            best = np.maximum(best, (h & (place >= k) & (place < k + T)).sum(1))
        good[at[best < NEED]] = False


def spans(hit: np.ndarray, good: np.ndarray) -> list[tuple[int, int]]:
    """First and last found shingle of each stretch of overlapping good windows."""
    at = np.flatnonzero(good)
    if not len(at):
        return []
    found, out = np.flatnonzero(hit), []
    for part in np.split(at, np.flatnonzero(np.diff(at) >= T) + 1):
        inside = found[np.searchsorted(found, part[0]) : np.searchsorted(found, part[-1] + T)]
        out.append((int(inside[0]), int(inside[-1])))
    return out


def passage_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each pair of segments its passages, as words of either text, and the items of the first text that no passage holds."""
    for batch in batches:
        for begin in range(0, len(batch), BLOCK):
            yield _passages(batch.iloc[begin : begin + BLOCK])


def _passages(part: pd.DataFrame) -> pd.DataFrame:
    x, y = np.zeros((2, len(part), SEGMENT + 2 * PAD), np.int32)
    for row, v in zip((*x, *y), (*part["x"], *part["y"]), strict=True):
        row[: len(v)] = v
    to_a, to_b = (part[f"q{e}"].to_numpy() * SEGMENT - PAD for e in "ab")
    a, b = [c - k for c, k in zip(part["ca"], to_a)], [c - k for c, k in zip(part["cb"], to_b)]
    diagonals = [np.unique(p - q) for p, q in zip(a, b, strict=True)]
    at, d = np.repeat(np.arange(len(part)), [len(v) for v in diagonals]), np.concatenate(diagonals)
    hit_a, good_a = near_windows(x[at], y[at], d)
    both = np.flatnonzero(good_a.any(1))
    hit_b, good_b = near_windows(y[at[both]], x[at[both]], -d[both])
    verified, mine, other = [np.zeros(len(v), bool) for v in a], [set() for _ in a], [set() for _ in a]
    for k, j in enumerate(both):
        if not good_b[k].any():
            continue
        i = at[j]
        here = np.flatnonzero(a[i] - b[i] == d[j])
        verified[i][here] = _held(good_a[j], a[i][here]) & _held(good_b[k], b[i][here])
        mine[i].update((s + int(to_a[i]), e + int(to_a[i]) + WIDTH - 1) for s, e in spans(hit_a[j], good_a[j]))
        other[i].update((s + int(to_b[i]), e + int(to_b[i]) + WIDTH - 1) for s, e in spans(hit_b[k], good_b[k]))
    named = {n: [[{"s": s, "e": e} for s, e in sorted(v)] for v in found] for n, found in (("ina", mine), ("inb", other))}
    left = {n: [c[~v] for c, v in zip(part[of], verified, strict=True)] for n, of in (("bkey", "bkey"), ("c", "ca"))}
    return pd.DataFrame({"na": part["na"], "nb": part["nb"]} | named | left)


def _held(good: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether some good window of T shingles holds each place."""
    total = np.cumsum(np.concatenate([[0], good]))
    return total[np.minimum(at + 1, len(good))] > total[np.clip(at - T + 1, 0, len(good))]


def dense_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """vs: the shingles v of each item that have NEED - 1 others within T places p, from rare (df) to common; items with fewer than NEED are left out."""
    for batch in batches:
        kept, found = [], []
        for i, (p, df, v) in enumerate(zip(batch["p"], batch["df"], batch["v"], strict=True)):
            order = np.argsort(p)
            p, df, v = p[order], df[order], v[order]
            dense = np.flatnonzero(p[NEED - 1 :] - p[: len(p) - NEED + 1] < T)
            if not len(dense):
                continue
            inside = np.zeros(len(p) + 1, int)
            np.add.at(inside, dense, 1)
            np.subtract.at(inside, dense + NEED, 1)
            inside = np.flatnonzero(np.cumsum(inside[:-1]))
            v, first = np.unique(v[inside], return_index=True)
            if len(v) >= NEED:
                kept.append(i)
                found.append(v[np.lexsort((v, df[inside][first]))])
        yield batch[["bkey", "g", "node", "c"]].iloc[kept].assign(vs=pd.Series(found, index=batch.index[kept], dtype=object))


PASSAGE = "array<struct<s:int,e:int>>"


class ExactRepeats:
    """Windows of T shingles that several texts hold: ``found`` (node, s, e) of their words and ``edges`` (a, b) of their texts, once ``run``."""

    def __init__(self, s: Scratch, items: DataFrame):
        self.s, self.items = s, items
        # one row a content, however many items have it
        one = self.items.groupBy("ekey", "content").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.min(F.struct("node", "c", "lo", "hi")).alias("i"))
        self.contents = s.save(one.select("ekey", "content", "least", "most", "i.*").withColumn("q", F.floor(F.col("c") / SEGMENT).cast("int")))
        several = s.save(self.contents.groupBy("ekey").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a < b").select("ekey"))
        self.open = s.save(self.contents.join(several.hint("merge"), "ekey", "left_semi"))
        s.drop(several)

    def run(self, segments: DataFrame) -> None:
        s = self.s
        around = self.open.join(segments.hint("merge"), ["node", "q"]).select("ekey", "content", "least", "most", "c", "lo", "hi", "x")
        windows = s.save(around.mapInPandas(window_rows, "ekey long, content long, least long, most long, w long, at int"))
        shared = s.save(windows.groupBy("ekey", "w").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last").select("ekey", "w", "first"))
        met = s.save(windows.join(shared.hint("merge"), ["ekey", "w"]).groupBy("ekey", "content").agg(F.min("at").alias("from"), F.max("at").alias("to"), F.collect_set("first").alias("firsts")))
        # an item's windows all hold one side of its anchor, so the first and the last repeated one tell the words of all
        whole = self.contents.where("least < most").select("ekey", "content", F.col("lo").cast("int").alias("from"), F.col("hi").cast("int").alias("to"), "least")
        part = met.join(self.contents.where("least = most").select("ekey", "content", "least").hint("merge"), ["ekey", "content"]).select("ekey", "content", "from", "to", "least")
        spans = s.save(whole.union(part))
        every = s.save(self.items.select("ekey", "content", "node", "c").join(spans.hint("merge"), ["ekey", "content"]).select("node", (F.col("c") + F.col("from")).alias("s"), (F.col("c") + F.col("to") + T + WIDTH - 2).alias("e"), "least"))
        across = met.join(self.contents.select("ekey", "content", "least").hint("merge"), ["ekey", "content"]).select(F.col("least").alias("a"), F.explode("firsts").alias("b"))
        self.edges = s.save(every.select(F.col("node").alias("a"), F.col("least").alias("b")).union(across).where("a != b").distinct())
        self.found = s.save(every.select("node", "s", "e").distinct())
        s.drop(windows, shared, met, spans, every, self.items, self.contents, self.open)


class Comparison:
    """Rounds of comparisons of items, (bkey, node, c), with representatives of their buckets."""

    def __init__(self, s: Scratch, members: DataFrame, segments: DataFrame, known: DataFrame):
        self.s, self.members, self.segments, self.known, self.done = s, members, segments, known, []

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(bkey, node, c) of the items ``(bkey, node, c, node2, c2)`` that are not verified; verified ones go to ``done``."""
        segment = lambda c: F.floor(F.col(c) / SEGMENT).cast("int")
        item = F.struct("bkey", F.col("c").alias("ca"), F.col("c2").alias("cb"))
        by_segment = pairs.groupBy(F.col("node").alias("na"), segment("c").alias("qa"), F.col("node2").alias("nb"), segment("c2").alias("qb")).agg(F.collect_list(item).alias("items"))
        a, b = (self.segments.select(F.col("node").alias(f"n{e}"), F.col("q").alias(f"q{e}"), F.col("x").alias(x)) for e, x in ("ax", "by"))
        by_segment = by_segment.select("na", "qa", "nb", "qb", *[F.col(f"items.{x}").alias(x) for x in ("bkey", "ca", "cb")])
        both = by_segment.join(a.hint("merge"), ["na", "qa"]).join(b.hint("merge"), ["nb", "qb"])
        out = self.s.save(both.mapInPandas(passage_rows, f"na long, nb long, ina {PASSAGE}, inb {PASSAGE}, bkey array<long>, c array<int>"))
        self.done.append(out)
        return out.select(F.col("na").alias("node"), F.inline(F.arrays_zip("bkey", "c"))).select("bkey", "node", "c").distinct()

    def representatives(self, items: DataFrame) -> DataFrame:
        rep = items.groupBy("bkey").agg(F.min(F.struct("node", "c")).alias("rep"))
        # written, so that the join below is of plain tables, whose hot buckets can be split
        return self.s.save(rep.select("bkey", F.col("rep.node").alias("node2"), F.col("rep.c").alias("c2")))

    def run(self) -> None:
        open_ = None
        for r in range(ROUNDS):
            before = self.members if open_ is None else open_
            reps = self.representatives(before)
            pairs = before.join(reps.hint("merge"), "bkey")
            left = self.s.save(self.verify(pairs.where("node != node2")))
            # of the representative's own text no other item was compared
            open_ = self.s.save(left.union(pairs.where("node = node2 and c != c2").select("bkey", "node", "c")))
            if r == 0:
                # the first representative has met all others; a bucket is done unless two more items are left
                met = reps.select("bkey", F.col("node2").alias("node"), F.col("c2").alias("c"))
                others = self.members.join(met.hint("merge"), ["bkey", "node", "c"], "left_anti")
                others = self.s.save(others.join(self.s.save(open_.select("bkey").distinct()).hint("merge"), "bkey", "left_semi"))
            self.s.drop(reps, left)
            if open_.isEmpty():
                break
        self.comps = components(self.s, union([self.known, *map(self.edges, self.done)]))
        self.verify(self.rest(others))
        self.comps = extended(self.s, self.comps, self.edges(self.done[-1]))

    @staticmethod
    def edges(done: DataFrame) -> DataFrame:
        return done.where(F.size("ina") > 0).select(F.col("na").alias("a"), F.col("nb").alias("b"))

    def rest(self, items: DataFrame) -> DataFrame:
        """All pairs of items of a bucket, in different classes so far, that may still hold a passage, by a prefix filter.

        A window that holds an anchor lies within REACH shingles of it, and two that match share NEED
        shingles. Shingles that stand in one class only of the bucket are left out, and so are those without
        NEED others in T places. Items of one class with the same shingles left count
        once. The shingles are ordered from rare to common; a pair shares one of the first
        n - NEED + 1 of both and NEED of all, so text that all items of a bucket share joins nobody.
        """
        items = items.join(self.comps.hint("merge"), "node", "left")
        items = items.select("bkey", "node", "c", F.coalesce("comp", "node").alias("g"), F.floor(F.col("c") / SEGMENT).cast("int").alias("q"))
        items = self.s.save(items)
        # one of the buckets with the same items is enough
        one = F.xxhash64("node", "c")
        same = [F.count("*").alias("n"), F.sum(one.bitwiseAND(F.lit(2**40 - 1))).alias("sum"), F.bit_xor(one).alias("xor")]
        several = items.groupBy("bkey").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), *same).where("lo < hi")
        several = self.s.save(several.groupBy("lo", "hi", "n", "sum", "xor").agg(F.min("bkey").alias("bkey")).select("bkey"))
        items = items.join(several.hint("merge"), "bkey", "left_semi")
        near = F.slice("x", F.col("c") - F.col("q") * SEGMENT + PAD - REACH + 1, 2 * REACH + 1)
        around = self.s.save(items.join(self.segments.hint("merge"), ["node", "q"]).select("bkey", "g", "node", "c", near.alias("near")))
        # items of one class with the same shingles around them count once
        alike = around.groupBy("bkey", "g", F.xxhash64("near").alias("h")).agg(F.min(F.struct("node", "c")).alias("i")).select("bkey", "g", "i.*")
        around = around.join(alike.hint("merge"), ["bkey", "g", "node", "c"], "left_semi")
        each = self.s.save(around.select("bkey", "g", "node", "c", F.posexplode("near").alias("p", "v")).where("v != 0"))
        df = self.s.save(each.groupBy("bkey", "v").agg(F.count("*").alias("df"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("bkey", "v", "df"))
        rows = each.join(df.hint("merge"), ["bkey", "v"]).groupBy("bkey", "g", "node", "c").agg(F.collect_list(F.struct("p", "df", "v")).alias("left")).where(F.size("left") >= NEED)
        rows = rows.select("bkey", "g", "node", "c", *[F.col(f"left.{x}").alias(x) for x in ("p", "df", "v")]).mapInPandas(dense_rows, "bkey long, g long, node long, c int, vs array<int>")
        rows = rows.groupBy("bkey", "g", "vs").agg(F.min(F.struct("node", "c")).alias("i")).select("bkey", "g", "i.*", "vs")
        keys = lambda vs: F.slice(vs, 1, F.size(vs) - NEED + 1)
        front = self.s.save(rows.select("*", F.explode(keys("vs")).alias("v")))
        other = front.select("bkey", "v", *[F.col(x).alias(f"{x}2") for x in ("g", "node", "c", "vs")])
        # all of it is the join's condition: a pair is a row once, at its first common shingle, and only if it shares enough
        x, y = front.alias("x"), other.alias("y").hint("merge")
        first = F.get(F.array_intersect(keys("vs"), keys("vs2")), F.lit(0)) == F.col("x.v")
        enough = F.size(F.array_intersect("vs", "vs2")) >= NEED
        met = x.join(y, (F.col("x.bkey") == F.col("y.bkey")) & (F.col("x.v") == F.col("y.v")) & (F.col("g") < F.col("g2")) & (F.col("node") != F.col("node2")) & first & enough)
        return met.select("x.bkey", "node", "c", "node2", "c2")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def passages(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """rows (doc_id, key, node, n_words), comps (node, comp) of linked texts, found (node, s, e) of repeated words."""
    s = Scratch(docs.sparkSession, clean=True)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"))
    schema = "doc_id long, key binary, batch long, n_words long, bkeys array<long>, anchors array<int>, ekeys array<long>, contents array<long>, places array<int>, los array<tinyint>, his array<tinyint>"
    made = s.save(keyed.mapInPandas(cell_rows, schema).withColumn("node", F.xxhash64("key")))
    items = s.save(repeated(made))
    members = s.save(items.where("not exact").select(F.col("key").alias("bkey"), "node", "c").distinct())
    exact = ExactRepeats(s, s.save(items.where("exact").select(F.col("key").alias("ekey"), "node", "content", "c", "lo", "hi").distinct()))
    wanted = members.select("node", "c").union(exact.open.select("node", "c")).groupBy("node").agg(F.sort_array(F.collect_set(F.floor(F.col("c") / SEGMENT).cast("int"))).alias("qs"))
    texts = bodies(s, keyed, made.select("doc_id", "key", "node"), s.save(wanted))
    segments = s.save(texts.mapInPandas(segment_rows, "node long, q int, x array<int>"))
    exact.run(segments)
    work = Comparison(s, members, segments, exact.edges)
    work.run()
    s.drop(items, members, segments)
    found = union([exact.found, *[out.select(F.col(f"n{e}").alias("node"), F.inline(f"in{e}")) for out in work.done for e in "ab"]])
    return made.select("doc_id", "key", "node", "n_words"), work.comps, found, s


def repeated_passages(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, class_id, class_size (rows in its class), n_words, n_dup_words, n_passages and passages (first and last word)."""
    rows, comps, found, s = passages(docs)
    one = found.distinct().groupBy("node").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    last = lambda a: F.element_at(a, -1)
    merge = lambda a, x: F.when((F.size(a) > 0) & (x["s"] <= last(a)["e"] + 1), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["s"].alias("s"), F.greatest(last(a)["e"], x["e"]).alias("e"))))).otherwise(F.concat(a, F.array(x)))
    merged = F.aggregate("spans", F.array().cast(PASSAGE), merge)
    # one row a text, then tables of texts joined to rows: copies of a text never meet in one task but where a join can be split
    texts = rows.where(F.col("n_words") >= MIN_WORDS).groupBy("key", "node", "n_words").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    named = texts.join(comps.hint("merge"), "node", "left").join(s.save(one).hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = F.array(F.struct(F.lit(0).alias("s"), (F.col("n_words") - 1).cast("int").alias("e")))
    named = s.save(named.select("key", "comp", "copies", "least", F.when(F.col("copies") > 1, whole).when(F.col("spans").isNotNull(), merged).alias("passages")))
    classes = s.save(named.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")))
    named = s.save(named.select("key", "comp", "passages").join(classes.hint("merge"), "comp").drop("comp"))
    out = rows.join(named.hint("merge"), "key", "left")
    words = F.aggregate("passages", F.lit(0), lambda a, x: a + x["e"] - x["s"] + 1)
    return out.select(
        "doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "n_words",
        F.coalesce(words, F.lit(0)).cast("long").alias("n_dup_words"), F.coalesce(F.size("passages"), F.lit(0)).cast("long").alias("n_passages"), "passages",
    )
