"""Labelled training rows: a bounded sample of documents with labels, the same for every run and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

#: Labelled documents that a classifier is fitted on at most.
SAMPLE = 8_000
#: Bytes of text at most that a model is fitted on.
SAMPLE_BYTES = 256 << 20


def within_bytes(rows: DataFrame, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """rows (o, id, t, ...), of which there are a bounded number, in order for as long as their texts fit into most_bytes together."""
    upto = F.sum(F.octet_length("t").cast("bigint")).over(Window.orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).filter(F.col("upto") <= most_bytes).drop("upto")


def sampled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """(o, id, t, y) of at most `most` documents (and SAMPLE_BYTES of text) that aren't held out, o a hash of the id: bounded, and in one partition.

    Null labels, ids and texts are left out; of labels that repeat an id the largest counts, of texts the smallest."""
    chosen = labels.filter(~held_out(F.col(id_col)) & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.select(F.col(id_col).alias("id"), "y", F.xxhash64(F.col(id_col).cast("string")).alias("o")).orderBy("o", "id").limit(most)
    # at most `most` rows of three numbers: a proven bound for the broadcast
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull()).join(F.broadcast(chosen), "id")
    return within_bytes(found.groupBy("id", "o", "y").agg(F.min("t").alias("t")))


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> list[tuple[str, int]]:
    """(text, label) of the sampled rows, in the order of o and id."""
    rows = sampled(docs, labels, label, id_col, text_col, most).collect()
    return [(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["o"], r["id"]))]
