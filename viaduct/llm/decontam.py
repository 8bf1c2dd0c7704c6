"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame functions only.

Texts are lower-cased and split into words at everything that is neither letter nor digit. Shingles are five words (an
item with fewer words is one shingle). An item of n words is looked for in windows of n words:

1. Placing windows. The similarity of a window and an item is the weighted Jaccard of their shingles, the weight of a
   shingle being its number of occurrences. At a similarity of t, windows and items of a and b occurrences have at least
   t * (a + b) / (1 + t) in common. So every position of a document whose shingle stands in some item of n words is
   marked, and every window of n words with so many marks is taken, wherever in the item its shingles stand. The numbers
   of marks come from running sums over the starts at which the marks come and go. No other window can reach t.
2. Candidates. Windows and items get 64-bit SimHashes, each occurrence voting once. Fingerprints are cut into
   radius + 1 blocks; two of them within the radius agree in a block at least, so joining on (words, block, bits)
   meets every such pair. A pair is taken at the first block in which it agrees, so it comes once.
3. Verifying. Candidates within the radius are compared by their exact weighted Jaccard, and stay at t or more.

The default radius of 20 lies 3.7 deviations above the expected distance of a pair at similarity 0.8 (9.7, deviation 2.9),
so that about one such pair in ten thousand is missed and of more similar ones fewer; an exact copy has distance 0. A radius
that wide makes narrow blocks, so most pairs of one length meet in some block; that is why only windows that can reach the
threshold get a fingerprint at all.

Null and empty texts and items without words match nothing. Each distinct pair of id and text has windows of its own, and each
distinct text of an item; rows that repeat an id, null ids too, fold to one document (or item) only at the end.
Only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised

WIDTH = 5
#: Words of a text in which the windows of one stretch of it begin.
STRETCH = 4096
#: Rows of a side at most for which it is broadcast; beyond, joins are shuffled.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """Hashes of all stretches of `width` words, in order."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    return F.when(F.size(words) >= width, F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def simhash_bits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp long, m long) from (keys, h): a bit is 1 if it is set in over half the occurrences."""
    # bits i and i + 32 are counted in one sum, in halves that don't meet below 2^31 occurrences
    both = (1 << 32) | 1
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(both)).alias(f"b{i}") for i in range(32)]
    voted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *sums)
    votes = lambda i: F.shiftrightunsigned(f"b{i % 32}", 32 * (i // 32)).bitwiseAND((1 << 32) - 1)
    bits = (F.when(votes(i) * 2 > F.col("m"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(64))
    return voted.select(*keys, "m", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of radius + 1 blocks that cover 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_bits(fp: Column, block: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, block[0]).bitwiseAND((1 << block[1]) - 1)


def hamming_pairs(left: DataFrame, right: DataFrame, radius: int, on: list[str]) -> DataFrame:
    """Every pair of left (fp, on, ...) and right (other_fp, on, ...) with equal `on` and at most `radius` differing bits, once."""
    cut = blocks(radius)

    def dealt(df: DataFrame, fp: str) -> DataFrame:
        return df.select("*", F.posexplode(F.array(*(block_bits(F.col(fp), b) for b in cut))).alias("block", "bits"))

    met = dealt(left, "fp").join(dealt(right, "other_fp"), [*on, "block", "bits"])
    differ = F.col("fp").bitwiseXOR(F.col("other_fp"))
    first = F.array_position(F.array(*(block_bits(differ, b) for b in cut)), F.lit(0).cast("bigint")) - 1
    return met.filter((F.bit_count(differ) <= radius) & (first == F.col("block"))).drop("block", "bits")


def placed_windows(hits: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, start) of all windows that can reach the threshold, from the marked positions (keys, at); keys hold width, n and size."""
    n, width, size, at = (F.col(c) for c in ("n", "width", "size", "at"))
    first = F.greatest(at - n + width, F.lit(0))
    after = F.greatest(F.least(at, size - n), F.lit(0)) + 1
    events = hits.select(*keys, F.explode(F.array(F.struct(first.alias("start"), F.lit(1).alias("d")), F.struct(after.alias("start"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(*keys, F.col("e.start").alias("start")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("start")
    runs = steps.select(*keys, "start", F.sum("d").over(order).alias("marks"), F.lead("start").over(order).alias("next"))
    common = threshold * (F.least(n, size) + n - 2 * width + 2) / (1 + threshold) - 1e-9
    return runs.filter((F.col("marks") >= common) & F.col("next").isNotNull()).select(*keys, F.explode(F.sequence("start", F.col("next") - 1)).alias("start"))


def stretches_of(texts: DataFrame, windows: DataFrame, longest: int) -> DataFrame:
    """(key, stretch, words): the texts (key, t) that have a window, cut into overlapping stretches, each of which holds whole all windows that begin in its first STRETCH words.

    So no row holds more than a text, and none behind the join more than a stretch, however many windows a text has. Repeated rows count once."""
    first = windows.groupBy("key").agg(F.collect_set(F.floor(F.col("start") / STRETCH)).alias("own"))
    held = texts.join(small(first, windows.count()), "key").dropDuplicates(["key"]).select("key", "own", words_of(F.col("t")).alias("words"))
    cut = F.transform("own", lambda k: F.struct(k.alias("stretch"), F.slice(F.col("words"), (k * STRETCH + 1).cast("int"), STRETCH + longest).alias("words")))
    return held.select("key", F.explode(cut).alias("s")).select("key", "s.*")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, radius: int = 20) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, differing_bits): each document with each item that it holds, at the best window."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("words"))
    items = items.select("item_id", F.md5(F.array_join("words", " ")).alias("item"), F.size("words").alias("n"), "words").filter("n > 0")
    names = items.select("item", "item_id").distinct()
    wide = F.least(F.col("n"), F.lit(WIDTH))
    per_width = [items.filter(wide == k).select("item", "n", F.lit(k).alias("width"), F.posexplode(shingles_of(F.col("words"), k)).alias("o", "h")) for k in range(1, WIDTH + 1)]
    occurrences = materialised(reduce(DataFrame.union, per_width).distinct(), "items")  # items of one text are one until the end
    n_rows = occurrences.count()
    marks = occurrences.select("width", "h", "n").distinct()
    widths = [r[0] for r in occurrences.select("width").distinct().collect()]  # five at most
    own_id = F.when(F.col(id_col).isNull(), "null").otherwise(F.md5(F.col(id_col).cast("string")))
    key = F.md5(F.concat(own_id, F.coalesce(F.col(text_col), F.lit(""))))
    texts = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), words_of(F.col(text_col)).alias("words"))
    hits = None
    for k in widths:
        rows = texts.select("doc_id", "key", F.size("words").alias("size"), F.posexplode(shingles_of(F.col("words"), k)).alias("at", "h"))
        own = marks.filter(F.col("width") == k).select("h", "n", "width")
        found = rows.join(small(own, n_rows), "h").select("doc_id", "key", "width", "n", "size", "at")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        return docs.sparkSession.range(0).select(F.lit(None).cast(docs.schema[id_col].dataType).alias("doc_id"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0).alias("differing_bits"))
    windows_at = materialised(placed_windows(hits.distinct(), ["doc_id", "key", "width", "n", "size"], threshold), "windows")
    longest = occurrences.agg(F.max("n")).first()[0]
    stretches = stretches_of(docs.select(key.alias("key"), F.col(text_col).alias("t")), windows_at, int(longest))
    at = ["doc_id", "key", "width", "n", "start"]
    placed = windows_at.withColumn("stretch", F.floor(F.col("start") / STRETCH))
    cut = placed.join(stretches, ["key", "stretch"]).select(*at, F.slice("words", (F.col("start") - F.col("stretch") * STRETCH + 1).cast("int"), F.col("n")).alias("words"))
    per_width = [cut.filter(F.col("width") == k).select(*at, F.explode(shingles_of(F.col("words"), k)).alias("h")) for k in widths]
    shingled = materialised(reduce(DataFrame.union, per_width), "shingles")
    windows = simhash_bits(shingled, at)
    items_fp = simhash_bits(occurrences, ["item", "width", "n"]).select("item", "width", "n", F.col("fp").alias("other_fp"), F.col("m").alias("item_m"))
    near = hamming_pairs(windows, small(items_fp, n_rows), radius, ["width", "n"])
    near = near.select("doc_id", "key", "item", "width", "n", "start", "m", "item_m", F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))).alias("differing_bits"))
    weights = shingled.groupBy("key", "width", "n", "start", "h").agg(F.count(F.lit(1)).alias("c"))
    item_weights = occurrences.groupBy("item", "width", "h").agg(F.count(F.lit(1)).alias("item_c"))
    both = near.join(weights, ["key", "width", "n", "start"])
    shared = both.join(small(item_weights, n_rows), ["item", "width", "h"])
    verified = shared.groupBy(*at, "item", "m", "item_m", "differing_bits").agg(F.sum(F.least("c", "item_c")).alias("common"))
    verified = verified.select("doc_id", "item", (F.col("common") / (F.col("m") + F.col("item_m") - F.col("common"))).alias("similarity"), "start", "n", "differing_bits").filter(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("start", "n", "differing_bits"), F.struct("similarity", -F.col("start"))).alias("b")
    verified = verified.join(names, "item")
    return verified.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best).select("doc_id", "item_id", "similarity", F.col("b.start").alias("start_word"), F.col("b.n").alias("n_words"), F.col("b.differing_bits").alias("differing_bits"))
