"""Exact deduplication by a cuckoo-filter index over text digests.

Every text becomes its SHA-256 digest, after lower-casing A-Z only, inside the JVM. Copies are counted before the shuffle, so a
digest that a third of all rows share arrives as one row from each task. Digests are dealt to buckets, and each
bucket keeps a cuckoo filter of short fingerprints; a hit is verified against the bucket's stored digests, so a
fingerprint that two digests share costs a look and never a wrong answer. A digest whose keeper changes is deleted and
inserted again, and an overflowing filter is rebuilt at twice its size from the stored digests.

Null and empty texts count as equal. A null doc_id is below every other id. Rows that repeat a doc_id are rows of their
own in group_size; of those that share the largest id all are marked kept. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

SLOTS, KICKS = 4, 256


class CuckooIndex:
    """Live digests (bytes, at least 16) with a value each: a filter of 16-bit fingerprints over a store of whole digests."""

    def __init__(self, buckets: int = 1 << 10):
        self.store: dict[bytes, tuple] = {}
        self.false_hits = self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]

    def __len__(self) -> int:
        return len(self.store)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        at = int.from_bytes(digest[8:16], "big") & self.mask
        return mark, at, self._other(at, mark)

    def _other(self, at: int, mark: int) -> int:
        return at ^ (mark * 0x5BD1E995 & self.mask)

    def _place(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for at in (a, b):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        at = b
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[at][slot] = self.table[at][slot], mark
            at = self._other(at, mark)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        return False

    def _resize(self) -> None:
        while True:
            self.resizes += 1
            self._clear(2 * (self.mask + 1))
            if all(map(self._place, self.store)):
                return

    def get(self, digest: bytes) -> tuple | None:
        mark, a, b = self._places(digest)
        if mark not in self.table[a] and mark not in self.table[b]:
            return None
        value = self.store.get(digest)
        self.false_hits += value is None
        return value

    def insert(self, digest: bytes, value: tuple) -> None:
        """The digest must not be live."""
        self.store[digest] = value
        if not self._place(digest):
            self._resize()

    def delete(self, digest: bytes) -> tuple | None:
        value = self.get(digest)
        if value is not None:
            mark, a, b = self._places(digest)
            self.table[a if mark in self.table[a] else b].remove(mark)
            del self.store[digest]
        return value


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def folded(rows: DataFrame, most: int | None, by_bucket: bool) -> DataFrame:
    """(digest, keep_id, group_size) rows with the same columns folded through a CuckooIndex in each task.

    most: live digests at which the index is handed on and emptied; by_bucket: rows come bucket by bucket (the digest's
    first byte), and the index is handed on and emptied after each. Either way it holds a bounded part."""

    def out(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
        rows = list(index.store.items())
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], ["digest", "keep_id", "group_size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bucket = CuckooIndex(), None
        for batch in batches:
            for d, keep, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if by_bucket and d[0] != bucket or most and len(index) >= most:
                    yield from out(index)
                    index, bucket = CuckooIndex(), d[0]
                had = index.get(d)
                if had is None:
                    index.insert(d, (keep, n))
                elif keep is not None and (had[0] is None or keep > had[0]):  # the keeper changes
                    index.delete(d)
                    index.insert(d, (keep, n + had[1]))
                else:
                    index.store[d] = (had[0], n + had[1])
        yield from out(index)

    return rows.mapInArrow(run, "digest binary, keep_id bigint, group_size bigint")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of df.

    A join on the digest with the groups that have copies brings the keeper back; its hot side is split by adaptive execution."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(digest(F.col(text_col))).alias("digest"))
    # copies meet in the task that reads them before anything moves: the shuffle carries a row for each digest and task
    counts = folded(rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")), 100_000, False)
    dealt = counts.repartition("digest").sortWithinPartitions(F.substring("digest", 1, 1))
    groups = folded(dealt, None, True).filter("group_size > 1")
    out = rows.join(groups, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
