"""Hard-negative mining over product codes: lookup tables and residual norms rule rows out, integers decide the rest.

Vectors become integers floor(256 * x) and are cut into parts of two components. Codebooks of 256 entries a part are fitted on
at most FIT rows; every row is coded, and the norm of what its code leaves out is stored beside it. For an anchor, a table
of the inner products of its parts with all entries gives every row's approximate score; the true one differs from it by
at most the anchor's norm times the row's residual norm (Cauchy-Schwarz, rounded upwards).

The rows that are best by the tables are scored in integers first. The last score that they need to fill a list is a floor
for the list, and only rows whose bound reaches it are scored too. So a list is exact: nothing that could enter it is left out.

Rows are dealt to blocks of about BLOCK rows by a hash, anchors likewise; each pair of blocks is one group of bounded size,
which keeps the first rows of each of its lists, and the lists of an anchor meet in a ranked window. All anchors meet all
rows in blocks, as a stated query set does; no row is shuffled more often than there are blocks of anchors.

Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Rows that repeat an id are
rows of their own, ties beyond the id don't show in the result. Shorter vectors count as if they went on with zeros;
components are clamped to +-2^26 after scaling. An empty table, and one without anchors, has no result. Only the id,
vector and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised
from .vector_codes import above, dimension, integers, matrix, padded, scan, squared, usable

WIDTH, ENTRIES, FIT, FIT_ROUNDS = 2, 256, 4096, 4
#: Rows of a block of rows, of a block of anchors; anchors whose scores are held at the same time.
BLOCK, ANCHORS, HELD = 8192, 2048, 32
#: Rows scored in integers first, as a multiple of the rows that are sought.
FIRST = 4


def fit(q: np.ndarray, entries: int = ENTRIES, width: int = WIDTH, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Integer codebooks (parts, entries, width), begun with evenly spaced rows of q."""
    parts = q.shape[1] // width
    cut = q.reshape(len(q), parts, width)
    books = cut[np.linspace(0, len(q) - 1, min(entries, len(q))).astype(int)].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for p in range(parts):
            code = scan(cut[:, p], books[p])[0]
            n = np.bincount(code, minlength=len(books[p]))
            total = np.stack([np.bincount(code, cut[:, p, j], len(books[p])) for j in range(width)], axis=1)
            books[p][n > 0] = np.floor(total[n > 0] / n[n > 0, None]).astype(np.int64)
    return books


def encode(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and upper bounds of the residuals' norms."""
    parts, _, width = books.shape
    cut = q.reshape(len(q), parts, width)
    code = np.stack([squared(cut[:, p], books[p]).argmin(axis=1) for p in range(parts)], axis=1).astype(np.uint8) if parts else np.zeros((len(q), 0), np.uint8)
    d = cut - books[np.arange(parts), code]
    return code, above(np.sqrt((d * d).sum(axis=(1, 2))))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by the smaller id."""
    return np.lexsort((ids, -score))[:k]


def leading(at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of k of the highest scores of score[at], in any order."""
    return at if len(at) <= k else at[np.argpartition(score[at], len(at) - k)[len(at) - k :]]


class Block:
    """A block of coded rows that anchors are scored against."""

    def __init__(self, rows: pa.Table, books: np.ndarray):
        self.books, self.dim = books, books.shape[0] * books.shape[2]
        rows = rows.combine_chunks()
        self.row, self.ids, self.labels = (rows.column(c).to_numpy() for c in ("row", "id", "label"))
        self.q = matrix(rows.column("q").combine_chunks(), self.dim).astype(np.int64)
        self.code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), books.shape[0]).T.copy()
        self.residual = rows.column("residual").to_numpy()
        self.scored = 0

    def bounds(self, anchors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each anchor its approximate scores of all rows, and how far the true ones may lie from them."""
        parts, _, width = self.books.shape
        for at in range(0, len(anchors), HELD):
            a = anchors[at : at + HELD]
            score = np.zeros((len(a), len(self.ids)), np.int64)
            for p in range(parts):
                table = a[:, p * width : (p + 1) * width] @ self.books[p].T
                score += table[:, self.code[p]]
            norms = above(np.sqrt((a * a).sum(axis=1).astype(float)))
            for s, norm in zip(score, norms, strict=True):
                yield s, above(norm * self.residual)

    def exact(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        self.scored += len(at)
        return self.q[at] @ anchor

    def top(self, anchor: np.ndarray, at: np.ndarray, score: np.ndarray, slack: np.ndarray, k: int, high: float = np.inf, low: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of `at` with the highest true scores from low to high, and these scores; all, if fewer."""
        could = at[(score[at] + slack[at] >= low) & (score[at] - slack[at] <= high)]
        first = leading(could[score[could] <= high], score, FIRST * k)
        known = self.exact(first, anchor)
        inside = known[(known >= low) & (known <= high)]
        floor = np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else low
        could = could[score[could] + slack[could] >= floor]
        known = self.exact(could, anchor)
        inside = (known >= max(low, floor)) & (known <= high)
        could, known = could[inside], known[inside]
        own = best(known, self.ids[could], k)
        return could[own], known[own]


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers n with low * score <= 100 * n <= high * score, as their least and greatest."""
    return -(-low * score // 100), high * score // 100


def coded(df: DataFrame, label: Column, id_col: str, vec_col: str) -> tuple[DataFrame, np.ndarray]:
    """(row, id, label, q, code, residual) of all rows that take part, and the codebooks; fitted on FIT rows by a hash of the id."""
    usable_rows = df.filter(usable(F.col(vec_col)) & label.isNotNull() & F.col(id_col).isNotNull())
    q = usable_rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), integers(F.col(vec_col)).alias("q"))
    dim = dimension(q, "q", 1)
    dim += dim % WIDTH
    rows = materialised(q.withColumn("q", padded(F.col("q"), dim)), "vectors")
    sample = [r["q"] for r in rows.orderBy(F.xxhash64("id"), "id", "q").limit(FIT).select("q").collect()]
    books = fit(np.array(sample, np.int64).reshape(len(sample), dim)) if sample else np.zeros((dim // WIDTH, 0, WIDTH), np.int64)
    sent = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, residual = encode(matrix(batch.column("q"), dim).astype(np.int64), sent.value)
            own = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(residual)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "code", "residual"])

    return materialised(rows.mapInArrow(run, "row long, id long, label long, q array<int>, code binary, residual double"), "coded"), books


def _tiles(rows: DataFrame, anchors: DataFrame, block: int, anchor_block: int):
    """Rows and anchors dealt to all pairs of their blocks, as groups that belong together."""
    n, m = max(1, -(-rows.count() // block)), max(1, -(-anchors.count() // anchor_block))
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    left = rows.select("*", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("tile"), every(m, "anchor_tile"))
    right = anchors.select("*", F.pmod(F.xxhash64("a_row"), F.lit(m)).cast("int").alias("anchor_tile"), every(n, "tile"))
    return left.groupBy("tile", "anchor_tile").cogroup(right.groupBy("tile", "anchor_tile"))


def _ranked(df: DataFrame, key: list[str], score: str, ident: str, row: str, k: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), ident, row)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, anchor_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` holds, an expression over `id`.

    label: an expression over df. A negative's score is from low to high per cent of the positive's."""
    rows, books = coded(df, label, id_col, vec_col)
    dim = books.shape[0] * books.shape[2]
    sent = df.sparkSession.sparkContext.broadcast(books)
    own = rows.filter(F.coalesce(anchor, F.lit(False))).select(F.col("row").alias("a_row"), F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("q").alias("a_q"))

    def anchors_of(table: pa.Table) -> np.ndarray:
        return matrix(table.column("a_q").combine_chunks(), dim).astype(np.int64)

    def near(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(rows) and len(anchors):
            b, vectors = Block(rows, sent.value), anchors_of(anchors)
            keys = zip(anchors.column("a_row").to_pylist(), anchors.column("a_label").to_pylist(), strict=True)
            for (a_row, a_label), a, (score, slack) in zip(keys, vectors, b.bounds(vectors), strict=True):
                at, known = b.top(a, np.flatnonzero((b.labels == a_label) & (b.row != a_row)), score, slack, positives)
                for o, x in zip(out, (np.full(len(at), a_row), b.row[at], b.ids[at], known), strict=True):
                    o.append(x)
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *o]) for c, o in zip(("a_row", "p_row", "p_id", "p_score"), out, strict=True)})

    found = _tiles(rows, own, block, anchor_block).applyInArrow(near, "a_row long, p_row long, p_id long, p_score long")
    chosen = _ranked(found, ["a_row"], "p_score", "p_id", "p_row", positives)
    listed = chosen.groupBy("a_row").agg(F.sort_array(F.collect_list(F.struct("rank", "p_id", "p_score"))).alias("chosen"))  # `positives` at most
    asked = materialised(own.join(listed, "a_row"), "positives")

    def far(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if len(rows) and len(anchors):
            b, vectors = Block(rows, sent.value), anchors_of(anchors)
            keys = zip(*(anchors.column(c).to_pylist() for c in ("a_row", "a_label", "chosen")), strict=True)
            for (a_row, a_label, chosen), a, (score, slack) in zip(keys, vectors, b.bounds(vectors), strict=True):
                others = np.flatnonzero(b.labels != a_label)
                for p in chosen:
                    least, most = _window(p["p_score"], low, high)
                    at, known = b.top(a, others, score, slack, negatives, most, least) if least <= most else (others[:0], others[:0])
                    for o, x in zip(out, (np.full(len(at), a_row), np.full(len(at), p["rank"]), b.row[at], b.ids[at], known), strict=True):
                        o.append(x)
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *o]) for c, o in zip(("a_row", "p_rank", "n_row", "negative_id", "negative_score"), out, strict=True)})

    met = _tiles(rows, asked, block, anchor_block).applyInArrow(far, "a_row long, p_rank long, n_row long, negative_id long, negative_score long")
    last = _ranked(met, ["a_row", "p_rank"], "negative_score", "negative_id", "n_row", negatives)
    names = asked.select("a_row", F.col("a_id").alias("anchor_id"), F.explode("chosen").alias("p"))
    names = names.select("a_row", "anchor_id", F.col("p.rank").cast("bigint").alias("p_rank"), F.col("p.p_id").alias("positive_id"), F.col("p.p_score").alias("positive_score"))
    return last.join(names, ["a_row", "p_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
