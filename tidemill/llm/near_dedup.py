"""Near-duplicate documents by ProbMinHash sketches of weighted word shingles.

A text's shingles (five words) weigh 1 + ln(count). Each shingle has a Poisson
process whose rate is its weight: its arrivals hit one of M registers at random,
and a register keeps the shingle that arrives first (Ertl 2020). A shingle stops
early, once its next arrival is later than the latest register. Two registers agree
with the probability Jaccard similarity of the texts. Bands of R registers are
bucket keys; pairs in a bucket are verified on their whole shingle sets, and
texts are linked if the Jaccard similarity of those is 0.8 or more. With M = 128 and R = 4 a pair
whose probability Jaccard similarity is 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8. Repeated
shingles weigh more in the sketch than in the verified sets, so a pair's chance can
differ a little; the test measures recall by brute force.

Exact copies are one text from the start. Classes are connected components.

Nulls: a text without words (null, empty, blank) has no shingle and is a class of
its own; its class_id is its own doc_id. class_id is the smallest doc_id of a
class, null only if all its doc_ids are. Repeated rows share a class. Fewer than
five words make one shingle. Very long texts are sketched and compared whole, one at a
time. Columns of docs other than doc_id and text are not read, whatever their names. Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, bodies, fresh, own, text_key
from .linking import link, repeated
from .shingles import GOLDEN, WordHashes, mix, shingles

M, R, WIDTH, SIMILARITY, CHUNK = 128, 4, 5, 0.8, 200_000


def sketch(sets: list[tuple[np.ndarray, np.ndarray]], m: int = M) -> np.ndarray:
    """Registers (len(sets) x m) of shingle hashes for sets of (hashes, weights), none of them empty."""
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    item, weight = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    first, owner = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    time, state = np.zeros(len(item)), item
    with np.errstate(over="ignore"):
        while len(item):
            state = state + GOLDEN
            a, b = mix(state), mix(state ^ np.uint64(0xD6E8FEB86659FD93))
            time = time - np.log((a >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / weight
            at = doc * m + (b % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, at, time)
            won = first[at] == time
            owner[at[won]] = item[won]
            latest = first.reshape(-1, m).max(1)
            alive = time < latest[doc]
            doc, item, weight, time, state = doc[alive], item[alive], weight[alive], time[alive], state[alive]
    return owner.reshape(-1, m)


def bands(registers: np.ndarray, r: int = R) -> np.ndarray:
    """One key per band of r registers."""
    out = np.zeros((len(registers), registers.shape[1] // r), np.uint64) + np.arange(registers.shape[1] // r, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(r):
            out = mix(out * GOLDEN + registers[:, k::r])
    return out.view(np.int64)


def weighted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.unique(shingles(words, WIDTH), return_counts=True)
    return h, 1 + np.log(n)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of sorted hashes."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _rows(texts) -> Iterator[list[int]]:
    """Row numbers of a batch in runs of about CHUNK words."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "") // 5
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def sketch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordHashes()
    for batch in batches:
        texts = batch["text"].tolist()
        for run in _rows(texts):
            sets = [weighted(words.of(texts[i])) for i in run]
            full = [k for k, (h, _) in enumerate(sets) if len(h)]
            keys = [np.zeros(0, np.int64)] * len(run)
            if full:
                for k, row in zip(full, bands(sketch([sets[k] for k in full])), strict=True):
                    keys[k] = row
            part = batch.iloc[run]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "key": part["key"].to_numpy(), "bands": keys})


def set_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordHashes()
    for batch in batches:
        for run in _rows(batch["text"].tolist()):
            part = batch.iloc[run]
            sets = [weighted(words.of(t)) for t in part["text"]]
            yield pd.DataFrame({"node": part["node"].to_numpy(), "h": [h.view(np.int64) for h, _ in sets]})


def compare_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        near = [similarity(np.asarray(x), np.asarray(y)) >= SIMILARITY for x, y in zip(batch["ha"], batch["hb"], strict=True)]
        yield batch.loc[near, ["na", "nb"]]


def prefix_candidates(s: Scratch, live: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of live nodes in different components that may reach SIMILARITY, by prefix and position filters (Xiao et al. 2008).

    Shingles of one component only can be common to no such pair and are left out; the
    others are ordered from rare to common. As the overlap of a pair is at least
    0.8 n for both, they share one of the first S - ceil(0.8 n) + 1 of the S that are left,
    and the places at which it stands bound their overlap from above. Texts that
    differ in their own ways from a common model have too few left, and meet nowhere.
    """
    nodes = live.select("node", "comp").distinct()
    each = s.save(nodes.join(sets, "node").select("node", "comp", F.size("h").alias("n"), F.explode("h").alias("t")))
    df = each.groupBy("t").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("t", "df")
    rows = each.join(df, "t").groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("left")).withColumn("m", F.size("left"))
    first = F.col("m") - F.ceil(F.col("n") * SIMILARITY - 1e-9).cast("int") + 1
    prefix = rows.withColumn("first", first).where("first > 0").withColumn("front", F.transform(F.slice("left", 1, F.greatest(F.lit(0), F.col("first"))), lambda x: x["t"]))
    prefix = s.save(prefix.select("node", "comp", "n", "m", "front", F.posexplode("front").alias("p", "t")))
    other = prefix.select("t", *[F.col(c).alias(f"{c}2") for c in ("node", "comp", "n", "m", "front", "p")])
    need = (F.col("n") + F.col("n2")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9
    bound = F.least("p", "p2") + F.least(F.col("m") - F.col("p"), F.col("m2") - F.col("p2"))
    # all of it is the join's condition: a pair is a row once, at its first common shingle, and only if it passes
    x, y = prefix.alias("x"), other.alias("y")
    pairs = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("comp") < F.col("comp2")) & (bound >= need) & (F.get(F.array_intersect("front", "front2"), F.lit(0)) == F.col("x.t")))
    return pairs.select(F.col("node").alias("item"), "node", F.col("node2").alias("item2"), "node2")


def classes(docs: DataFrame) -> tuple[DataFrame, Scratch]:
    """(doc_id, key, comp) for each row of docs; ``key`` stands for the text, ``comp`` for its class; null for texts without words."""
    s = Scratch(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"))
    rows = s.save(keyed.mapInPandas(sketch_rows, "doc_id long, key binary, bands array<long>"))
    # one row per text, numbered once: the table is written, so numbers stay
    texts = s.save(rows.where("size(bands) > 0").groupBy("key").agg(F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    members = repeated(s, texts.select(F.explode("bands").alias("bkey"), F.col("node").alias("item"), "node"))
    # a text in the middle of its group shares more bands with others
    central = s.save(members.groupBy("node").agg(F.count("*").cast("int").alias("central")))
    members = s.save(members.join(central.hint("merge"), "node"))
    # nodes grow with the data, so they are merged and never broadcast: one plan at every size
    nodes = s.save(texts.select("node", "key").join(central.select("node").hint("merge"), "node"))
    numbered = rows.join(nodes.hint("merge"), "key").select("doc_id", "key", "node")
    sets = s.save(bodies(s, keyed, s.save(numbered), nodes.select("node")).select("node", "text").mapInPandas(set_rows, "node long, h array<long>"))

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("node").alias("na"), F.col("h").alias("ha")), sets.select(F.col("node").alias("nb"), F.col("h").alias("hb"))
        return pairs.select("na", "nb").join(a, "na").join(b, "nb").mapInPandas(compare_rows, "na long, nb long")

    comps, _ = link(s, members, verify, lambda live: prefix_candidates(s, live, sets), rounds=2)
    named = texts.select("key", "node").join(comps, "node", "left").select("key", F.coalesce("comp", "node").alias("comp"))
    named = s.save(named)
    return rows.select("doc_id", "key").join(named, "key", "left"), s


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size for each row of docs."""
    rows, s = classes(docs)
    rows = s.save(rows)
    # written, so that the join is of plain tables, whose hot classes can be split
    names = s.save(rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    out = rows.join(names.hint("merge"), "comp", "left")
    return out.select("doc_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each class the row with the smallest doc_id (null last) stays, one of repeated rows."""
    rows, s = classes(docs)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("key"))
    comp, d, k, key = fresh("comp", "d", "k", "key")
    firsts = rows.where("comp is not null").groupBy(F.col("comp").alias(comp)).agg(F.min(order).alias("o")).select(comp, F.col("o.doc_id").alias(d), F.col("o.key").alias(k))
    firsts = s.save(firsts)
    keyed = docs.withColumn(key, text_key(F.col("text")))
    kept = keyed.join(firsts.hint("merge"), F.col(d).eqNullSafe(F.col("doc_id").cast("long")) & (F.col(k) == F.col(key)))
    blank = docs.where(F.length(F.translate(F.coalesce("text", F.lit("")), BLANKS, "")) == 0)
    return kept.dropDuplicates([comp]).select(*own(docs)).unionByName(blank)
