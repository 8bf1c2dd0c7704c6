"""Near-duplicates by SimHash: tiled exact comparison of fingerprints with numpy, then connected components.

Distinct fingerprints are dealt to stripes of one population count each; only stripes whose counts lie within the radius
meet. Inside a pair of stripes, tiles of fingerprints sorted by the counts of their four 16-bit sections meet where the
sections' ranges allow a distance within the radius. A met pair of tiles is compared in full by exclusive-or and bit
counts. A task hands on a spanning forest of its links, so that a group of copies yields no more rows than members.

Null and empty texts have fingerprint zero. Rows that repeat an id are rows of their own; a null id never names a
component unless all of its ids are null. Only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialised, over_texts
from .components import components, merge

STRIPE, TILE = 1 << 18, 512
#: Tasks at most of one comparison.
TASKS = 10_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_WORDS = re.compile(rb"[^\x20\x09-\x0d]+").findall


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits, as a signed integer: a bit is 1 if it is set in over half the hashes of the text's shingles."""
    words = _WORDS((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - width].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long) of every whole text."""

    def make() -> Callable:
        return lambda text: (fingerprint(text, width, seed),)

    return over_texts(df, id_col, text_col, "fp long", ["fp"], make)


def _sections(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _tiled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x sorted by section counts; the least and the greatest counts in each tile."""
    s = _sections(x)
    order = np.lexsort((s[:, 3], s[:, 2], s[:, 1], s[:, 0], s[:, 0] + s[:, 1]))
    x, s = x[order], s[order]
    cuts = np.arange(0, len(x), TILE)
    return x, np.minimum.reduceat(s, cuts, axis=0), np.maximum.reduceat(s, cuts, axis=0)


def links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (x, root of x) of the pairs within radius: between a and b, or inside a if b is None."""
    a, a_lo, a_hi = _tiled(a)
    same = b is None
    b, b_lo, b_hi = (a, a_lo, a_hi) if same else _tiled(b)
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    parent = np.arange(len(nodes))
    for i in range(len(a_lo)):
        apart = np.maximum(np.maximum(b_lo - a_hi[i], a_lo[i] - b_hi), 0).sum(axis=1)
        row = a[i * TILE : (i + 1) * TILE, None]
        for j in np.flatnonzero(apart <= radius):
            if same and j < i:
                continue
            near = np.bitwise_count(row ^ b[None, j * TILE : (j + 1) * TILE]) <= radius
            if same and i == j:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            u, v = np.nonzero(near)
            u, v = u + i * TILE, v + j * TILE + shift
            parent = merge(parent, u, v)
    other = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[other], nodes[parent[other]]


def met_stripes(rows: DataFrame, c: Column, reach: int, stripe: int) -> DataFrame:
    """rows dealt to pairs of stripes (lo, hi): stripes of at most `stripe` rows or so of one class each, met where classes differ by `reach` at most.

    c: the row's class, a whole number from 0; classes are few (counts of 64 bits, or logarithms), so their sizes go to the driver.
    A row whose own stripe is the greater one of its pair is marked `second`."""
    rows = rows.withColumn("c", c.cast("int"))
    counts = dict(rows.groupBy("c").count().collect())
    if not counts:
        return rows.limit(0).select(*(x for x in rows.columns if x != "c"), F.lit(False).alias("second"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    most = max(counts)
    parts = {k: -(-n // stripe) for k, n in counts.items()}
    table = F.array(*(F.lit(parts.get(k, 0)) for k in range(most + 1)))
    names = [x for x in rows.columns if x != "c"]
    dealt = rows.withColumn("p", F.pmod(F.xxhash64(*names), F.get(table, F.col("c"))).cast("int"))
    dealt = dealt.withColumn("c2", F.explode(F.sequence(F.greatest(F.col("c") - reach, F.lit(0)), F.least(F.col("c") + reach, F.lit(most)))))
    dealt = dealt.filter(F.get(table, F.col("c2")) > 0).withColumn("p2", F.explode(F.sequence(F.lit(0), F.get(table, F.col("c2")) - 1)))
    own, far = F.struct("c", "p"), F.struct(F.col("c2").alias("c"), F.col("p2").alias("p"))
    dealt = dealt.select(*names, (own > far).alias("second"), F.least(own, far).alias("lo"), F.greatest(own, far).alias("hi"))
    # a pair's work is its rows squared, so tasks are set by the pairs and not by the bytes
    pairs = sum(n * (n + 1) // 2 + n * sum(parts.get(k + r, 0) for r in range(1, reach + 1)) for k, n in parts.items())
    return dealt.repartition(min(pairs, TASKS), "lo", "hi")


def near_pairs(fps: DataFrame, radius: int = 4, stripe: int = STRIPE) -> DataFrame:
    """(a, b) links that connect the distinct fingerprints of fps (fp long) just as all pairs within radius do."""

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        second = group.column("second").to_numpy()
        a, b = links(fp, None, radius) if key[0].as_py() == key[1].as_py() else links(fp[~second], fp[second], radius) if second.any() and not second.all() else (fp[:0], fp[:0])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    rows = met_stripes(fps.select("fp"), F.bit_count("fp"), radius, stripe)
    return rows.groupBy("lo", "hi").applyInArrow(compare, "a long, b long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest id that its links reach."""
    rows = materialised(fingerprints(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", width, seed), "fingerprints")
    classes = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(near_pairs(classes.select("fp"), radius))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialised(joined, "rooted")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(joined.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
