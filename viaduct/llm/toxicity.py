"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and the stems of longer ones (their first STEM letters), hashed to 2^BITS buckets. Fitting
learns a weight and K factors for every bucket that a training text holds; the factors' inner products score pairs of terms
that stand in one text, which no sum of weights can. Buckets whose presence differs between the classes beyond chance take
AdaGrad steps on the logistic loss; the others learn from their summed gradients beyond a pull to zero, so that rare terms
aren't learned by heart but a term that matters only together with another is learned. A text counts each
term once, so a toxic line weighs the same in a long text. The cut between the classes is set by parts of the training
rows that the model in question has not learned from. Null and empty texts have the bias alone. Rows are scored on
their own, so ties, repeats and hot keys need no care. Without labels of both kinds the score is the label that there
is, or 0.5.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import Memo, over_texts

BITS, K, EPOCHS, STEM = 22, 4, 6, 5
#: Deviation of the first factors; the pull of weights and factors to zero, in deviations of a sum of chance gradients.
START, PULL_W, PULL_V, DECAY = 0.02, 2.5, 2.5, 1e-3
_WORDS = re.compile(r"\w+").findall


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) * 2654435761 % (1 << 32) >> (32 - BITS)


def buckets(word: str) -> tuple[int, ...]:
    return (bucket(word), bucket(word[:STEM] + "*")) if len(word) > STEM else (bucket(word),)


def words(text: str | None) -> set[str]:
    return set(_WORDS((text or "").lower()))


def fit(rows: list[tuple[str, int]], seed: int = 7) -> dict:
    """{'buckets': sorted, 'bias', 'w', 'v'}, a weight and factors for each bucket."""
    y = np.array([b for _, b in rows], np.int64)
    nothing = {"buckets": np.zeros(0, np.int32), "w": np.zeros(0), "v": np.zeros((0, K))}
    if len(set(y.tolist())) < 2:
        return nothing | {"bias": 0.0 if not len(y) else 9.0 if y[0] else -9.0}
    of = Memo(buckets).__getitem__
    docs = [np.unique(np.fromiter(chain.from_iterable(map(of, words(text))), np.int32)) for text, _ in rows]
    ones = sum(y)
    zeros = len(y) - ones
    held, total = np.unique(np.concatenate(docs), return_counts=True)  # every bucket that a training text holds
    h1 = np.bincount(np.searchsorted(held, np.concatenate([d for d, b in zip(docs, y, strict=True) if b])), minlength=len(held))
    p = total / len(y)
    z = (h1 / ones - (total - h1) / zeros) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / ones + 1 / zeros))
    free = (np.abs(z) >= 3) & (total >= 2)  # these learn without a pull, all others against it
    # n summed gradients are at most sqrt(n) of their root sum of squares, so a bucket of `total` texts can pass a pull of
    # PULL * sqrt(epochs) only if total > PULL ** 2: the others stay at zero whatever the order, and needn't be carried
    can = free | (total > min(PULL_W, PULL_V) ** 2)
    kept, free = held[can], free[can]
    if not len(kept):
        return nothing | {"bias": float(np.log(ones / zeros))}
    order = np.argsort(~free, kind="stable")  # the free ones first
    place, n_free = np.argsort(order), int(free.sum())
    active = []
    for d in docs:
        at = np.minimum(np.searchsorted(kept, d), len(kept) - 1)
        x = place[at[kept[at] == d]]
        active.append((x[x < n_free], x[x >= n_free]))
    kept, free = kept[order], np.arange(len(kept)) < n_free
    rng = np.random.default_rng(seed)
    start = rng.normal(0, 1, (len(kept), K)) * np.where(free, 0.05, START)[:, None]
    w, v, bias = np.zeros(len(kept)), start.copy(), float(np.log(ones / zeros))
    zw, zv, gw, gv, gb = np.zeros(len(kept)), np.zeros((len(kept), K)), np.full(len(kept), 1e-2), np.where(free, 1e-2, 1e-4)[:, None] * np.ones(K), 1e-2
    for epoch in range(EPOCHS):
        pull_w, pull_v = PULL_W * (epoch + 1) ** 0.5, PULL_V * (epoch + 1) ** 0.5
        for i in rng.permutation(len(active)).tolist():
            f, r = active[i]
            vf, vr = v[f], v[r]
            s = vf.sum(axis=0) + vr.sum(axis=0)
            dot = bias + w[f].sum() + w[r].sum() + 0.5 * float(s @ s - np.vdot(vf, vf) - np.vdot(vr, vr))
            g = 1.0 / (1.0 + np.exp(-min(max(dot, -30.0), 30.0))) - y[i]
            gb += g * g
            bias -= 0.2 * g / gb**0.5
            if len(f):
                wf = w[f]
                d = g + 1e-4 * wf
                gw[f] = own = gw[f] + d * d
                w[f] = wf - 0.3 * d / np.sqrt(own)
                d = g * (s - vf) + DECAY * vf
                gv[f] = own = gv[f] + d * d
                v[f] = vf - 0.05 * d / np.sqrt(own)
            if len(r):
                zw[r] = total = zw[r] + g
                gw[r] = own = gw[r] + g * g
                w[r] = -0.3 * _beyond(total, own, pull_w)
                d = g * (s - vr)
                zv[r] = total = zv[r] + d
                gv[r] = own = gv[r] + d * d
                v[r] = start[r] - 0.1 * _beyond(total, own, pull_v)
    v[(_beyond(zv, gv, pull_v) == 0) & ~free[:, None]] = 0  # what never left its start has learned nothing
    some = (w != 0) | (v != 0).any(axis=1)  # a bucket of zeros adds nothing to any score
    return {"buckets": kept[some], "bias": float(bias), "w": w[some].astype(np.float32), "v": v[some].astype(np.float32)}


def _beyond(total: np.ndarray, squares: np.ndarray, pull: float) -> np.ndarray:
    """The summed gradients in units of their root sum of squares, pulled to zero."""
    t = total / np.sqrt(squares)
    return t - np.minimum(np.maximum(t, -pull), pull)


class Scorer:
    def __init__(self, model: dict):
        known = {b: at for at, b in enumerate(model["buckets"].tolist())}

        def slots(word: str) -> tuple[int, ...]:
            return tuple(known[b] for b in buckets(word) if b in known)

        self.slots = Memo(slots).__getitem__
        self.w, self.v, self.bias = model["w"], model["v"], model["bias"]

    def score(self, text: str | None) -> float:
        found = set(chain.from_iterable(map(self.slots, words(text))))
        dot = self.bias
        if found:
            x = np.array(sorted(found))
            vx = self.v[x]
            s = vx.sum(axis=0)
            dot += float(self.w[x].sum() + 0.5 * ((s * s).sum() - (vx * vx).sum()))
        return float(1.0 / (1.0 + np.exp(-min(max(dot, -30.0), 30.0))))


def score_toxicity(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; the model (28 bytes a bucket of the training rows) goes to each executor once."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        score = Scorer(sent.value).score
        return lambda text: (score(text),)

    return over_texts(df, id_col, text_col, "score double", ["score"], make)


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The log odds at which a score should count as 1: the greatest F-measure (F1), in the middle of its gap.

    0 where there are no rows of both kinds."""
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum(y[order])
    if not len(y) or not 0 < hit[-1] < len(y):
        return 0.0
    found, s = np.arange(1, len(y) + 1), scores[order]
    f = 2 * hit / (hit[-1] + found)
    f[:-1][s[:-1] == s[1:]] = -1  # equal scores go together
    k = int(f.argmax())
    odds = np.log(np.clip(s, 1e-6, 1 - 1e-6) / (1 - np.clip(s, 1e-6, 1 - 1e-6)))
    return float((odds[k] + odds[min(k + 1, len(odds) - 1)]) / 2)


def fit_and_cut(rows: list[tuple[str, int]], folds: int = 4, used: int = 2) -> dict:
    """fit(rows), its bias moved so that 0.5 is the best cut for rows that were not learned from.

    For that, `used` of the `folds` parts of the training rows (by a checksum of their texts) are scored by models of the
    other parts. Rows outside of the training rows have no say in it."""
    part = np.array([zlib.crc32((text or "").encode("utf-8", "replace")) % folds for text, _ in rows], np.int64)
    scores, y = [], []
    for k in range(used):
        score = Scorer(fit([r for r, p in zip(rows, part, strict=True) if p != k])).score
        own = [r for r, p in zip(rows, part, strict=True) if p == k]
        scores += [score(text) for text, _ in own]
        y += [label for _, label in own]
    model = fit(rows)
    return model | {"bias": model["bias"] - best_cut(np.array(scores), np.array(y, np.int64))}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    from .labelled import sample

    return fit_and_cut(sample(docs, labels, label))
