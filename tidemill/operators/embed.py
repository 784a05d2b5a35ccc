"""Sequence embedding of windows behind a pluggable function.

An embedder maps a float matrix (batch x window) to a matrix (batch x d). The
built-in one needs no weights: it joins the log power spectrum, autocorrelations and
quantiles of the standardised window. A pretrained model fits the same interface
and is loaded once per task by ``make``; a stored table of embeddings fits
``sources.cache_or_compute``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[np.ndarray], np.ndarray]


class SpectralEmbedder:
    """d numbers per window: half log spectrum, a quarter autocorrelation, the rest quantiles; zeros fill up."""

    def __init__(self, d: int = 1024):
        self.d = d

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x - x.mean(1, keepdims=True)
        x = x / np.maximum(x.std(1, keepdims=True), 1e-9)
        n = x.shape[1]
        power = np.abs(np.fft.rfft(x, 2 * n, axis=1)) ** 2
        acf = np.fft.irfft(power, axis=1)[:, : n // 2] / n
        spectrum = np.log1p(np.abs(np.fft.rfft(x, axis=1)) ** 2 / n)
        quantiles = np.quantile(x, np.linspace(0, 1, 65), axis=1).T
        out = np.concatenate([spectrum, acf, quantiles], 1)[:, : self.d]
        return np.pad(out, ((0, 0), (0, self.d - out.shape[1]))).astype(np.float32)


def embed(arrays: DataFrame, make: Callable[[], Embedder] = SpectralEmbedder, column: str = "values", batch: int = 64) -> DataFrame:
    """The array column replaced by ``embedding``; other columns stay. Windows go through in batches, one model per task."""
    others = [f for f in arrays.schema.fields if f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "embedding array<float>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or make()
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield part.drop(columns=column).assign(embedding=list(model(np.array(part[column].tolist(), np.float32))))

    return arrays.mapInPandas(run, schema)
