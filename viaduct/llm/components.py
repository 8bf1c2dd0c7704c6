"""Connected components of a distributed edge list: forests in each partition, then alternating large-star and small-star steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_dir


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Edges that one task holds at a time.
HELD = 1 << 21


def merge(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """parent with the trees of u and v made one, pairwise; every tree is flat and its root is its smallest place."""
    while True:
        pu, pv = parent[u], parent[v]
        differ = pu != pv
        if not differ.any():
            return parent
        u, v, pu, pv = u[differ], v[differ], pu[differ], pv[differ]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars (node, root) with the same components, HELD edges at a time."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = merge(np.arange(len(nodes)), place[: len(u)], place[len(u) :])
        other = np.flatnonzero(parent != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[parent[other]])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield stars()
            held.clear()
    if held:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that it can reach.

    Each task first makes stars of the edges that it holds, so that few rounds are left; every round halves the paths at least. Only counts reach the driver. Each round is a table in the shared folder and
    the one before it is deleted. A hub's rows meet in joins that adaptive execution can split; none is collected."""
    spark = edges.sparkSession
    base = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    kind = edges.schema["a"].dataType.simpleString()
    now, at, step = _saved(pairs.mapInArrow(forests, f"u {kind}, v {kind}"), f"{base}/0"), f"{base}/0", 0
    mark = _mark(now)
    while True:
        step += 1
        # large star: neighbours above u go to the smallest neighbour of u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its neighbours below go to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        then = _saved(small.filter("u <> v").distinct(), f"{base}/{step}")
        remove(spark, at)
        now, at, before = then, f"{base}/{step}", mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
