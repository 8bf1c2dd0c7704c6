"""The toxicity model's score against pairs written out, its cut, and held-out rows that had no say in either."""

import os
import zlib
from itertools import combinations

import numpy as np
import pytest

from viaduct.llm import toxicity
from viaduct.llm.labelled import sample

SF = "/root/testdata/sf0.1"


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(30)] + ["prefixes", "prefixed"]
    buckets = sorted({b for w in words for b in toxicity.buckets(w)})
    model = {"buckets": np.array(buckets), "bias": -0.3, "w": rng.normal(size=len(buckets)), "v": rng.normal(size=(len(buckets), toxicity.K))}
    score = toxicity.Scorer(model).score
    for text in ("w1 w2 w3", "prefixes prefixed w1", "W5 w5 w5", "unknown", "", None, " ".join(words)):
        found = sorted({b for w in toxicity.words(text) for b in toxicity.buckets(w) if b in buckets})
        at = [buckets.index(b) for b in found]
        dot = model["bias"] + sum(model["w"][i] for i in at) + sum(float(model["v"][i] @ model["v"][j]) for i, j in combinations(at, 2))
        assert score(text) == pytest.approx(1 / (1 + np.exp(-dot)), rel=1e-9)


def test_best_cut():
    y = np.array([1, 1, 1, 0, 0, 0, 1, 0])
    s = np.array([0.9, 0.8, 0.3, 0.1, 0.1, 0.05, 0.04, 0.01])
    cut = 1 / (1 + np.exp(-toxicity.best_cut(s, y)))
    assert 0.1 < cut < 0.3  # three of four without a false one
    assert toxicity.best_cut(np.zeros(0), np.zeros(0, np.int64)) == 0.0 == toxicity.best_cut(s, np.ones(8, np.int64)) == toxicity.best_cut(s, np.zeros(8, np.int64))
    tied = toxicity.best_cut(np.full(6, 0.5), np.array([1, 1, 1, 0, 0, 0]))
    assert tied == pytest.approx(0.0)


def test_cut_without_rows_to_set_it_by():
    for rows in ([], [("a", 1)], [("a", 1), ("b", 0)], [(None, 0), ("", 1)] * 3):
        assert 0 <= toxicity.Scorer(toxicity.fit_and_cut(rows)).score("a") <= 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_rows(spark):
    """Nine tenths of the toxic rows are caught and 99 % of the others kept, the model and its cut made from training rows alone."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = sample(docs, labels, "toxic")
    score = toxicity.Scorer(toxicity.fit_and_cut(rows)).score
    held = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["doc_id"] in held}
    caught = {y: [score(texts[i]) >= 0.5 for i in texts if held[i] == y] for y in (0, 1)}
    assert sum(caught[1]) >= 0.9 * len(caught[1]) and sum(caught[0]) <= 0.01 * len(caught[0])
