"""Quality classifier: attention-based multiple-instance learning (Ilse, Tomczak, Welling 2018).

A document is a bag of passages of PASSAGE words. Each passage is encoded by
measures of its text and a learned tanh layer, h. Gated attention weighs the
passages, a = softmax(w (tanh(V h) * sigmoid(U h))), and the document's score is
sigmoid(c . sum(a h) + d). All of it is learned from document labels.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0, from
a sample of at most ``max_rows`` of them, chosen by a hash of doc_id. Passage
encoding runs on executors; the driver receives the sample's encoded passages
only, at most ``max_bag`` per sampled document (evenly spread, in learning
only), so its memory is bounded by max_rows * max_bag * len(MEASURES) numbers.
Every passage of every text is scored. No label, lang, source or doc_id enters a score.

Nulls: a null text is scored as an empty one, which is a bag of one passage of
zeros; a null doc_id is not held out, and never learned from; null labels are
left out. Rows that repeat are scored one by one; repeated labels of a doc_id
count once, with the lowest. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, own

PASSAGE, HIDDEN, ATTENTION, THRESHOLD = 128, 16, 8, 0.3
MEASURES = ("words", "word_length", "distinct", "adjacent", "symbols", "marks", "stops", "digits", "capitals", "high_bytes", "initial_capitals")
_SYMBOLS, _MARKS, _STOPS, _DIGITS, _CAPITALS = b"#*$%&|<>@^~=+_\\/[]{}", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HIGH = bytes(range(128, 256))


def passages(text: str | None) -> np.ndarray:
    """One row of MEASURES per passage of a text."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros((1, len(MEASURES)), np.float32)
    out = []
    for i in range(0, len(words), PASSAGE):
        w = words[i : i + PASSAGE]
        if len(w) < PASSAGE // 4 and i:
            w = words[-PASSAGE:]  # a short rest is seen with what stands before it
        n, p = len(w), b"".join(w)
        c = len(p)
        share = lambda chars: (c - len(p.translate(None, chars))) / c  # noqa: B023, E731
        initials = bytes(x[0] for x in w)
        out.append((
            np.log1p(n), np.log1p(c / n), len(set(w)) / n, sum(map(eq, w[1:], w)) / n, share(_SYMBOLS), share(_MARKS), share(_STOPS), share(_DIGITS), share(_CAPITALS), share(_HIGH),
            1 - len(initials.translate(None, _CAPITALS)) / n,
        ))
    return np.array(out, np.float32)


class Model:
    """Gated-attention MIL in numpy: ``fit`` on bags, ``score`` on stacked bags."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        d = len(MEASURES)
        self.mean, self.std, self.fitted = np.zeros(d), np.ones(d), False
        self.p = {"W": g.normal(0, 0.4, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": g.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": g.normal(0, 0.3, (HIDDEN, ATTENTION)), "w": g.normal(0, 0.3, ATTENTION), "c": g.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}

    def _forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
        p, bag = self.p, np.repeat(np.arange(len(starts)), sizes)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y}

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6)

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
        if len(set(labels.tolist())) < 2:
            return self
        every = np.concatenate(bags).astype(float)
        self.mean, self.std = every.mean(0), np.maximum(every.std(0), 1e-3)
        bags = [self._scaled(b) for b in bags]
        g, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = g.permutation(len(bags))
            for i in range(0, len(order), 64):
                at = order[i : i + 64]
                sizes = np.array([len(bags[k]) for k in at])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                grad = self._gradient(self._forward(np.concatenate([bags[k] for k in at]), starts, sizes), labels[at], starts)
                step += 1
                for k, dk in grad.items():
                    dk = dk + decay * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * dk
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * dk**2
                    self.p[k] = self.p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.fitted = True
        return self

    def _gradient(self, f: dict, y: np.ndarray, starts: np.ndarray) -> dict:
        p, n = self.p, len(y)
        dy = (f["y"] - y) / n
        dz = dy[:, None] * p["c"]
        dzb = dz[f["bag"]]
        da = (dzb * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dzb + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(bags), 0.5)
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return self._forward(self._scaled(np.concatenate(bags)), starts, sizes)["y"]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bag: int = 64) -> Model:
    """A model learned from at most ``max_rows`` labelled rows that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where("crc32(cast(doc_id as string)) % 5 != 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id"), "text").join(F.broadcast(known), "doc_id")
    # where a doc_id repeats, the row whose text has the least hash
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text")).select("text", F.col("quality").cast("int").alias("quality"), "doc_id")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [passages(t) for t in batch["text"]]
            bags = [b[np.unique(np.linspace(0, len(b) - 1, min(len(b), max_bag)).astype(int))] for b in bags]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "bag": [b.ravel() for b in bags]})

    rows = texts.mapInPandas(encode, "doc_id long, quality int, bag array<float>").toPandas()  # at most max_rows
    if not len(rows):
        return Model()
    rows = rows.assign(n=rows["bag"].map(len)).sort_values(["doc_id", "n"], kind="stable")
    return Model().fit([np.asarray(b, float).reshape(-1, len(MEASURES)) for b in rows["bag"]], rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with ``column``, the score of every whole text."""
    out = docs.schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.concatenate([model.score([passages(t) for t in batch["text"].iloc[i : i + 500]]) for i in range(0, len(batch), 500)]) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), column: values})

    if out == ["doc_id", "text"]:
        return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, f"doc_id long, {column} double")
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.concatenate([model.score([passages(x) for x in t.iloc[i : i + 500]]) for i in range(0, len(t), 500)])) if len(t) else pd.Series([], dtype=float)

    return docs.withColumn(column, of("text"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels, max_rows))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    (value,) = fresh("score")
    return score(docs, fit(docs, labels, max_rows), value).where(F.col(value) >= threshold).select(*own(docs))
