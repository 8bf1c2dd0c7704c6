"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

Tokens are runs of word characters and runs of other visible characters. Single tokens and pairs of neighbours are
hashed to 2^BITS features, and so are the patterns "a a" and "a _ a" of any repeated token; a feature's value is its share of the text's n-grams times SCALE, so the sparse dot product
is a mean of weights whatever the text's length. Null and empty texts have the bias alone. Rows are scored on their
own, so ties, repeats and hot keys need no care. Without labels of both kinds the score is the share of label 1, or 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, over_texts

BITS, SCALE, EPOCHS = 20, 40.0, 2
#: Labelled documents that the weights are fitted on at most.
SAMPLE = 6_000
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_MASK = np.uint64((1 << BITS) - 1)
#: Hashes of the patterns "a a" and "a _ a" for any token a.
_AGAIN = (np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5A))
_hash = Memo(lambda w: zlib.crc32(w.encode("utf-8", "replace")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def features(text: str | None) -> np.ndarray:
    """Indices of all single tokens, pairs of neighbours and repetitions, as often as they occur."""
    tokens = _TOKENS(text or "")
    h = np.fromiter(map(_hash.__getitem__, tokens), np.uint64, len(tokens))
    if not len(h):
        return np.zeros(0, np.int64)
    pairs = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h[1:] >> np.uint64(7))
    again = [np.full(int((h[k:] == h[:-k]).sum()), _AGAIN[k - 1]) for k in (1, 2)]
    both = np.concatenate([h, pairs, *again])
    return ((both ^ (both >> np.uint64(29))) & _MASK).astype(np.int64)


def fit(rows: list[tuple[str, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the bias last) by FTRL-proximal steps, one row at a time, the last one first. Features are kept in eight bytes each."""
    rows = list(rows)
    n = (1 << BITS) + 1
    z, s = np.zeros(n), np.zeros(n)
    labels = [y for _, y in rows]
    weights = np.zeros(n, np.float32)
    if len(set(labels)) < 2:
        weights[-1] = 0.0 if not labels else 9.0 if labels[0] else -9.0
        return weights
    cached = []
    while rows:  # a text goes when its features are there
        text, y = rows.pop()
        idx, counts = np.unique(features(text), return_counts=True)
        cached.append((np.append(idx, n - 1).astype(np.int32), np.append(counts * (SCALE / max(counts.sum(), 1)), 1.0).astype(np.float32), y))
    for _ in range(epochs):
        for idx, x, y in cached:
            x = x.astype(np.float64)
            zi, si = z[idx], s[idx]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(si)) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            step = (np.sqrt(si + g * g) - np.sqrt(si)) / alpha
            z[idx] = zi + g - step * w
            s[idx] = si + g * g
    weights[:] = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(s)) / alpha + l2))
    return weights


def score(weights: np.ndarray, text: str | None) -> float:
    idx = features(text)
    dot = float(weights[-1]) + (float(weights[idx].sum(dtype=np.float64)) * SCALE / len(idx) if len(idx) else 0.0)
    return float(1.0 / (1.0 + np.exp(-min(max(dot, -30.0), 30.0))))


def score_quality(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; the weights (4 MB) go to each executor once."""
    sent = df.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = sent.value
        return lambda text: (score(w, text),)

    return over_texts(df, id_col, text_col, "score double", ["score"], make)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Fitted on at most SAMPLE labelled documents, by one task: neither their texts nor their features come to the driver, only the weights."""
    from .labelled import sampled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).tobytes()], pa.binary())], ["weights"])

    rows = sampled(docs, labels, label, most=SAMPLE).repartition(1).sortWithinPartitions("o", "id").select("t", "y")
    found = rows.mapInArrow(run, "weights binary").first()
    return np.frombuffer(found[0], np.float32).copy() if found else fit([])


def keep_good(df: DataFrame, weights: np.ndarray, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of df, all columns, whose text scores at least threshold."""
    sent = df.sparkSession.sparkContext.broadcast(weights)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array([score(w, t) >= threshold for t in part.column(at).to_pylist()]))

    return df.mapInArrow(run, df.schema)
