"""SimHash near-duplicates with an exact check: links are pairs of texts that share at least 0.8 of their shingles of five words.

The operator of simhash.py, for a similarity instead of a radius. A text is the set of its shingles (one shingle if it has
fewer words, none if it has no words), as 64-bit hashes. Equal sets, empty ones too, are one class and are compared once.

1. Candidates. A class has LANES fingerprints of 64 bits, voted by its set. Stripes of similar size meet (sets at 0.8 differ
   in size by a quarter at most); inside, tiles whose sizes or population counts lie too far apart are skipped, and all
   others are compared in full by exclusive-or and bit counts: of the first fingerprint, then of all for the few that are
   left. At a similarity of 0.8 the expected distance is 9.7 of 64 bits and 38.8 of 256, with deviations of 2.9 and 5.7;
   the radii of 22 and 63 lie more than four deviations above. Sets below SMALL shingles have coarser votes (two of four and five
   shingles differ in 12 and 48 bits) and get radii of 28 and 80. So of pairs at exactly 0.8 fewer than one in five
   thousand are not met (measured in the tests), and of more similar ones fewer still.
2. Verifying. Candidates are compared by their whole sets. Only components matter, so pairs that links have connected
   already are skipped. First each class is compared with its nearest candidate. Classes that have one get FINE
   fingerprints, whose distance tells similarities apart by about 0.02, and each is compared with its nearest candidate of
   another component; at the end all candidates that still lie in two components are compared. So a group of near
   copies is connected by about as many comparisons as it has members, and only pairs close to the threshold are left.

Rows are named by a key without nulls or repeats, which the caller gives. Null texts are empty. A row keeps no other column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, materialised, over_texts
from .components import components
from .simhash import _LOWER, _WORDS, STRIPE, TILE, met_stripes

#: Fingerprints of every class, and of the classes that have a candidate.
LANES, FINE = 4, 64
#: By the number of fingerprints: (radius of the first one, radius of all), and the same for sets of fewer than SMALL shingles.
RADII, RADII_SMALL, SMALL = {LANES: (22, 63), FINE: (22, 734)}, {LANES: (28, 80), FINE: (28, 870)}, 16
#: Rounds of one comparison for each class; after them all candidates in two components are compared.
ROUNDS = 2
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int, word: Callable) -> np.ndarray:
    """Sorted distinct hashes; word(bytes) is the hash of a word."""
    words = _WORDS((text or "").encode().translate(_LOWER))
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(word, words), np.uint64, len(words))
    width = min(width, len(words))
    x = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        x = (x ^ h[k : k + len(x)]) * _P
        x ^= x >> np.uint64(29)
    return np.unique(x.view(np.int64))


def set_fingerprints(shingles: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """LANES words of 64 bits: a bit is 1 if it is set in over half the set's hashes, which are mixed anew for each word."""
    out = np.zeros(lanes, np.int64)
    if not len(shingles):
        return out
    x = shingles.view(np.uint64)
    for k in range(lanes):
        x = _mixed(x + _P)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 14):
            ones += np.unpackbits(x[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(x), bitorder="little").view(np.int64)[0]
    return out


def _words() -> Callable:
    return Memo(lambda w: xxhash.xxh64_intdigest(w, 42)).__getitem__


def _sets(df: DataFrame, key: str, text_col: str, width: int) -> DataFrame:
    """(key, shingles array<bigint>, fine array<bigint>)"""

    def make() -> Callable:
        word = _words()

        def one(text: str | None) -> tuple:
            x = shingle_set(text, width, word)
            return x, set_fingerprints(x, FINE)

        return one

    return over_texts(df, key, text_col, "shingles array<bigint>, fine array<bigint>", ["shingles", "fine"], make)


def _fingerprints(df: DataFrame, key: str, text_col: str, width: int) -> DataFrame:
    """(key, m: size of the set, digest of the set, fp array<bigint>)"""

    def make() -> Callable:
        word = _words()

        def one(text: str | None) -> tuple:
            x = shingle_set(text, width, word)
            return len(x), hashlib.md5(x.tobytes()).digest(), set_fingerprints(x)

        return one

    return over_texts(df, key, text_col, "m int, digest binary, fp array<bigint>", ["m", "digest", "fp"], make)


class Stripe:
    """Classes sorted by size, cut into tiles, with the ranges of sizes and of population counts in each."""

    def __init__(self, ids: np.ndarray, roots: np.ndarray, m: np.ndarray, fp: np.ndarray):
        ones = np.bitwise_count(fp[:, 0])
        by = np.lexsort((ones, m))
        self.ids, self.roots, self.m, self.fp, ones = ids[by], roots[by], m[by], fp[by], ones[by].astype(np.int16)
        self.first = np.ascontiguousarray(self.fp[:, 0])
        cuts = np.arange(0, len(m), TILE)
        self.least_m, self.most_m = np.minimum.reduceat(self.m, cuts), np.maximum.reduceat(self.m, cuts)
        self.least, self.most = np.minimum.reduceat(ones, cuts), np.maximum.reduceat(ones, cuts)


def distances(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Differing bits of x[u] and y[v], some pairs at a time."""
    out = np.zeros(len(u), np.uint64)
    for at in range(0, len(u), 1 << 14):
        part = slice(at, at + (1 << 14))
        out[part] = np.bitwise_count(x[u[part]] ^ y[v[part]]).sum(axis=1, dtype=np.uint64)
    return out


def candidates(a: Stripe, b: Stripe, threshold: float, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of candidates in two components, between a and b (or inside a, if b is a): all of them, or the nearest one of each class."""
    same = a is b
    wide, narrow = RADII_SMALL[a.fp.shape[1]], RADII[a.fp.shape[1]]
    best_a = np.full(len(a.ids), _NONE)
    best_b = best_a if same else np.full(len(b.ids), _NONE)
    found: list[tuple] = [(a.ids[:0], a.ids[:0])]
    for i in range(len(a.least)):
        fits = (b.most_m >= threshold * a.least_m[i] - 1e-9) & (a.most_m[i] >= threshold * b.least_m - 1e-9)
        apart = np.maximum(b.least - a.most[i], a.least[i] - b.most)
        for j in np.flatnonzero(fits & (apart <= wide[0])).tolist():
            near, radius = wide if min(a.least_m[i], b.least_m[j]) < SMALL else narrow
            if apart[j] > near or (same and j < i):
                continue
            u, v = np.nonzero(np.bitwise_count(a.first[i * TILE : (i + 1) * TILE, None] ^ b.first[None, j * TILE : (j + 1) * TILE]) <= near)
            u, v = u + i * TILE, v + j * TILE
            if same and i == j:
                u, v = u[u < v], v[u < v]
            mu, mv = a.m[u], b.m[v]
            fit = (np.minimum(mu, mv) >= threshold * np.maximum(mu, mv) - 1e-9) & (a.roots[u] != b.roots[v])
            u, v = u[fit], v[fit]
            d = distances(a.fp, b.fp, u, v)
            met = d <= radius
            u, v, d = u[met], v[met], d[met]
            if not len(u):
                continue
            if every:
                found.append((a.ids[u], b.ids[v]))
                continue
            np.minimum.at(best_a, u, d << np.uint64(32) | v.astype(np.uint64))
            np.minimum.at(best_b, v, d << np.uint64(32) | u.astype(np.uint64))
    if every:
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        return x, y
    place = np.uint64(2**32 - 1)
    has_a, has_b = np.flatnonzero(best_a != _NONE), np.flatnonzero(best_b != _NONE)
    x, y = a.ids[has_a], b.ids[best_a[has_a] & place]
    if same:
        return x, y
    return np.concatenate([x, a.ids[best_b[has_b] & place]]), np.concatenate([y, b.ids[has_b]])


def _candidate_pairs(nodes: DataFrame, threshold: float, every: bool, stripe: int) -> DataFrame:
    """(a, b), a < b, of nodes (id, root, m, fp)."""

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        second = group.column("second").to_numpy()
        cols = [group.column(c).to_numpy().astype(np.int64) for c in ("id", "root", "m")]
        fp = group.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(second), -1)

        def side(mask: np.ndarray) -> Stripe:
            return Stripe(*(c[mask] for c in cols), fp[mask])

        if key[0].as_py() == key[1].as_py():
            one = side(~second)
            x, y = candidates(one, one, threshold, every)
        elif second.any() and not second.all():
            x, y = candidates(side(~second), side(second), threshold, every)
        else:
            x = y = cols[0][:0]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    # one class for each quarter more shingles, so that sets at the threshold lie in one class or in neighbouring ones
    size_class = F.floor(F.log(F.greatest("m", F.lit(1)).cast("double")) / F.lit(log(1 / threshold) * (1 + 1e-9)))
    rows = met_stripes(nodes.select("id", "root", "m", "fp"), size_class, 1, stripe)
    return rows.groupBy("lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have the threshold's similarity."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").filter(both >= threshold * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def simhash_groups(df: DataFrame, key: str = "row", text_col: str = "text", width: int = 5, threshold: float = 0.8, stripe: int = STRIPE) -> DataFrame:
    """(key, component): rows with one component are near-duplicates of each other, by links of the threshold or more.

    The radii are made for 0.8 and hold for higher thresholds; lower ones, whose pairs would lie beyond them, are refused."""
    if not 0.8 <= threshold < 1:
        raise ValueError(f"a threshold from 0.8 up to below 1 is needed, not {threshold}")
    rows = materialised(_fingerprints(df, key, text_col, width), "fingerprints")
    classes = materialised(rows.groupBy("digest").agg(F.min(key).alias("id"), F.first("m").alias("m"), F.first("fp").alias("fp")), "sets")
    least = ceil(threshold / (1 - threshold) - 1e-9)  # smaller sets reach the threshold with their equals alone
    nodes = classes.filter(F.col("m") >= least).select("id", F.col("id").alias("root"), "m", "fp")
    pairs = materialised(_candidate_pairs(nodes, threshold, False, stripe), "candidates")
    ids = materialised(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "met")  # all others have no candidate
    sets = materialised(_sets(df.select(F.col(key).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi"), "id", "text", width), "shingles")
    met = nodes.select("id", "root", "m").join(sets.select("id", F.col("fine").alias("fp")), "id")
    turn = 0
    while True:
        found = _verified(pairs, sets, threshold)
        if turn:  # links between components so far
            root = met.select("id", "root")
            found = found.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        found = materialised(found, "links")
        some = not found.isEmpty()
        if some:
            joined = components(found).toDF("root", "least")
            met = materialised(met.join(joined, "root", "left").select("id", F.coalesce("least", "root").alias("root"), "m", "fp"), "met-classes")
        if turn == ROUNDS:
            break
        turn = turn + 1 if some else ROUNDS
        pairs = materialised(_candidate_pairs(met, threshold, turn == ROUNDS, stripe), "candidates")
    named = classes.join(met.select("id", "root"), "id", "left").select("digest", F.coalesce("root", "id").alias("component"))
    return rows.select(key, "digest").join(named, "digest").select(key, "component")
