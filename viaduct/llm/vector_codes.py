"""Vector code compression: product codes whose codebooks are learned by Hamerly's form of Lloyd's rounds.

Components become the integers floor(256 * x), and vectors are cut into equal consecutive parts. Each part of each row keeps its
code, an upper bound of the distance to that entry and a lower bound of the distance to every other one; the three are
written to the shared folder after each round. When the entries have moved, the bounds move with them, and only where they
no longer prove that the old entry is strictly the nearest (after the upper bound was made exact) are all entries compared,
in integers, ties to the lower index. Bounds are rounded outwards, so they never claim what integers would not.

A round is one pass over the rows and one over their codes: sums are made in each task, and only parts x entries of them
meet. What the driver holds are the codebooks and the rows that begin them.

Rows without a vector, or with a null or non-finite component, are left out. Vectors may differ in length: shorter ones count
as if they went on with zeros, up to the longest, rounded up to whole parts. Components are clamped to +-2^26 after scaling, so
that distances fit in 64 bits. Rows that repeat an id are rows of their own; null ids are coded too and begin a codebook only
after all others; rows with one id begin it in the order of their vectors. An empty table has no rows and empty codebooks.
Only the id, vector and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised

PARTS, ENTRIES, ROUNDS, SCALE, MOST = 16, 64, 2, 256, 1 << 26
#: Rows that are compared with all entries at the same time.
SLICE = 2048


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, clamped to +-MOST."""
    most = float(MOST)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(most)), F.lit(-most))).cast("int"))


def padded(vector: Column, dim: int) -> Column:
    return F.concat(vector, F.array_repeat(F.lit(0), F.lit(dim) - F.size(vector)))


def dimension(rows: DataFrame, vector: str, parts: int) -> int:
    """The longest vector's length, rounded up to a multiple of parts; 0 without rows."""
    longest = rows.agg(F.max(F.size(vector))).first()[0] or 0
    return -(-longest // parts) * parts


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(rows.ravel()))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each entry, in integers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - entries[None, :, j]
        out += d * d
    return out


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, ties to the lower index; upper bound of its distance; lower bound of the second nearest's)."""
    code, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
    for at in range(0, len(x), SLICE):
        d = squared(x[at : at + SLICE], entries)
        own = slice(at, at + len(d))
        code[own] = d.argmin(axis=1)
        upper[own] = above(np.sqrt(d.min(axis=1)))
        if len(entries) > 1:
            lower[own] = below(np.sqrt(np.partition(d, 1, axis=1)[:, 1]))
    return code, upper, lower


def half_gaps(entries: np.ndarray) -> np.ndarray:
    """Half of each entry's distance to its nearest other, rounded down: nothing nearer to the entry is nearer to another."""
    d = squared(entries, entries).astype(float)
    np.fill_diagonal(d, np.inf)
    return below(below(np.sqrt(d.min(axis=1, initial=np.inf))) / 2)


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A part's codes and bounds after its entries have moved, and the rows that had to be compared with all entries."""
    upper = above(upper + moved[code])
    lower = below(lower - moved.max(initial=0.0))
    limit = np.maximum(lower, half_gaps(entries)[code])
    code = code.copy()
    open_ = np.flatnonzero(~(upper < limit))
    d = x[open_] - entries[code[open_]]
    upper[open_] = above(np.sqrt((d * d).sum(axis=1)))
    open_ = open_[~(upper[open_] < limit[open_])]
    code[open_], upper[open_], lower[open_] = scan(x[open_], entries)
    return code, upper, lower, open_


_STATE = "code array<int>, upper array<double>, lower array<double>, scans int"


def _round(rows: DataFrame, entries: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """rows (row columns, q, and from the second round on the state) with their new state."""
    parts, _, width = entries.shape
    kept = [f for f in rows.schema.fields if f.name not in ("code", "upper", "lower", "scans")]
    names = [f.name for f in kept]
    sent = rows.sparkSession.sparkContext.broadcast((entries, moved))  # parts x entries x width numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, moved = sent.value
        for batch in batches:
            n = batch.num_rows
            q = matrix(batch.column("q"), parts * width).astype(np.int64).reshape(n, parts, width)
            code, upper, lower = np.zeros((n, parts), np.int32), np.zeros((n, parts)), np.zeros((n, parts))
            scans = np.zeros(n, np.int32)
            if moved is not None:
                was = [matrix(batch.column(c), parts) for c in ("code", "upper", "lower")]
                scans += batch.column("scans").to_numpy()
            for p in range(parts):
                if moved is None:
                    code[:, p], upper[:, p], lower[:, p] = scan(q[:, p], entries[p])
                    scans += 1
                else:
                    code[:, p], upper[:, p], lower[:, p], scanned = assign(q[:, p], *(w[:, p] for w in was), entries[p], moved[p])
                    scans[scanned] += 1
            state = [lists(code), lists(upper), lists(lower), pa.array(scans)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *state], [*names, "code", "upper", "lower", "scans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, {_STATE}")


def _means(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Each entry's floor(sum / count) over its parts, or the entry itself where it has none; parts x entries rows meet."""
    parts, k, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            q = matrix(batch.column(0), parts * width).reshape(-1, parts, width)
            code = matrix(batch.column(1), parts)
            for p in range(parts):
                np.add.at(count[p], code[:, p], 1)
                np.add.at(total[p], code[:, p], q[:, p].astype(np.int64))
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), lists(total[part, entry])], ["part", "entry", "n", "total"])

    sums = state.select("q", "code").mapInArrow(run, "part long, entry long, n long, total array<long>")
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(j))).alias(f"t{j}") for j in range(width)))
    out = entries.copy()
    for r in sums.collect():  # parts x entries rows at most
        out[r["part"], r["entry"]] = [r[f"t{j}"] // r["n"] for j in range(width)]
    return out


def _distance_up(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return above(np.sqrt((d * d).sum(axis=-1)))


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows (id, label, code array<int>, error long, scans int), codebooks as parts x entries x components).

    error: the squared distances of all parts to their entries; scans: how often a part of the row was compared with all entries."""
    q = df.filter(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), integers(F.col(vec_col)).alias("q"))
    dim = dimension(q, "q", parts)
    rows = materialised(q.withColumn("q", padded(F.col("q"), dim)), "vectors")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    state, moved = materialised(_round(rows, books, None), "codes"), None
    for _ in range(rounds):
        means = _means(state, books)
        moved, books = _distance_up(means, books), means
        state = materialised(_round(state, books, moved), "codes")

    sent = df.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(parts)
        for batch in batches:
            code = matrix(batch.column("code"), parts)
            d = matrix(batch.column("q"), dim).astype(np.int64).reshape(-1, parts, dim // parts) - sent.value[at, code]
            error = pa.array((d * d).sum(axis=(1, 2)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "code")), error, batch.column("scans")], ["id", "label", "code", "error", "scans"])

    out = state.select("id", "label", "code", "scans", "q").mapInArrow(errors, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long, scans int")
    return materialised(out, "coded").withColumnsRenamed({"id": id_col, "label": label_col}), books


def hex_code(code: Column) -> Column:
    """Two lowercase hex digits for each part."""
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def with_label_error(rows: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """rows with label_error: the error summed over the rows of one label, those without a label together; null beyond 64 bits.

    Sums are made in each task first and written; a table of them that is small is broadcast by its size, a large one is shuffled."""
    sums = materialised(rows.groupBy(F.col(label).alias("__label")).agg(F.try_sum(error).alias("label_error")), "label_errors")
    return rows.join(sums, F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")


def joined_text(books: np.ndarray) -> str:
    """All components by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))
