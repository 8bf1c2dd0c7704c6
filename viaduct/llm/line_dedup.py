"""Line deduplication over levelled sorted runs of line keys, with DataFrame functions only.

A line's key is the MD5 of the line, stripped of ASCII white space at both ends and with A-Z lower-cased; only keys of
lines with at least `min_chars` code points count. Documents come in batches. A batch is folded to one row for each
key (documents that hold it, largest id among them) and written in buckets of the key, sorted. Runs are tables in the same
buckets, sorted alike, so a batch is anti-joined with them by merging: nothing is shuffled and no run is sorted again. Keys
that no run holds become a new run; the batch anti-joined with that run are repeats. `fanout` runs of one level are merged
(by full outer merge joins, as a key stands in one run only) to one run of the next level, so a key is rewritten once for
each level. At the end runs and repeats are summed.

Null and empty texts have one empty line. Each row counts as a document, also where ids repeat; a null id is below
every other. A repeated line inside a document counts once. Rows keep their columns; `n_lines` and `n_dropped` replace
columns of those names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialised, remove, shared_dir

BLANK = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(lines: Column, min_chars: int) -> Column:
    """For each line its key, or null if the line is short."""

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(BLANK))
        return F.when(F.char_length(bare) >= min_chars, F.md5(lower_ascii(bare).cast("binary")))

    return F.transform(lines, key)


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Scans of buckets of one file each are known to be sorted, for as long as it lasts."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Sorted, bucketed runs (key, n, top) by level, each key in one run only, and the later sightings of their keys.

    A run is a table of its own below `path`; the number of buckets is that of the session's shuffle partitions."""

    SCHEMA = "key binary, n bigint, top bigint"

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.repeats: list[str] = []

    def _saved(self, df: DataFrame, what: str) -> str:
        """The name of df as a table in buckets of the key, one sorted file for each; df is dealt to tasks by bucket."""
        name = f"{what}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.path}/{name}")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Rows of batch (key, ...) whose keys no run holds yet: one merge anti-join for each run."""
        for name in (name for level in self.levels for name in level):
            batch = batch.join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """batch: (key, doc_id), a row for each key of each document."""
        folded = batch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        first = not any(self.levels)
        with _sorted_buckets(self.spark):
            dealt = self._saved(folded.repartition(self.buckets, "key"), "run" if first else "batch")
            if first:
                self.levels[0].append(dealt)
                return
            rows = self.spark.table(dealt)
            run = self._saved(self.fresh(rows), "run")
            self.repeats.append(self._saved(rows.join(self.spark.table(run).select("key").hint("merge"), "key", "left_anti"), "repeats"))
            self._drop(dealt)
            self.levels[0].append(run)
            self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._saved(reduce(self._merged, map(self.spark.table, level)), f"level{k + 1}")
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)
                self.levels[k] = []
                for name in level:
                    self._drop(name)

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two sorted runs without a common key as one."""
        return a.join(b.withColumnsRenamed({"n": "n2", "top": "top2"}).hint("merge"), "key", "full_outer").select("key", F.coalesce("n", "n2").alias("n"), F.coalesce("top", "top2").alias("top"))

    def _read(self, names: list[str]) -> DataFrame:
        """Tables as one scan of their files. A union of bucketed scans won't do: Spark 4.1 takes it to be bucketed too, and an aggregate over it counts a key once for each table."""
        return self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.path}/{name}" for name in names)) if names else self.spark.createDataFrame([], self.SCHEMA)

    def runs(self) -> DataFrame:
        return self._read([name for level in self.levels for name in level])

    def totals(self) -> DataFrame:
        """(key, n, top) over all batches so far."""
        rows = self._read([*(name for level in self.levels for name in level), *self.repeats])
        return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def close(self) -> None:
        """Deletes all tables."""
        for name in [*(name for level in self.levels for name in level), *self.repeats]:
            self._drop(name)
        self.levels, self.repeats = [[]], []


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Rows of df with the text's repeated lines gone, n_lines (before) and n_dropped.

    A line goes if its key stands in at least min_docs documents and this document's id isn't the largest of them."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    # rows travel as one struct, so that no column of theirs clashes with those made here
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), lines_of(F.col(f"`{text_col}`")).alias("lines"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"))
    keyed = docs.select("doc_id", F.array_distinct(F.filter(keys_of(F.col("lines"), min_chars), F.isnotnull)).alias("keys"))
    exploded = keyed.select("doc_id", F.explode("keys").alias("key"))
    exploded = exploded.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), F.unhex("key").alias("key"))
    exploded.write.partitionBy("batch").parquet(f"{at}/keys")
    keys = spark.read.schema("doc_id bigint, key binary, batch int").parquet(f"{at}/keys")
    runs = LineRuns(spark, at, fanout)
    try:
        for b in range(batches):
            runs.add(keys.filter(F.col("batch") == b).select("key", "doc_id"))
        # written first, so that adaptive execution can split the next join's hot keys, or broadcast if the table is small
        common = materialised(runs.totals().filter(F.col("n") >= min_docs).select("key", "top"), "common-lines")
    finally:
        runs.close()
    gone = keys.join(common, "key").filter(~F.col("doc_id").eqNullSafe(F.col("top")))
    gone = gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set(F.lower(F.hex("key"))).alias("gone"))
    rows = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    pairs = F.arrays_zip(F.col("lines").alias("line"), keys_of(F.col("lines"), min_chars).alias("key"))
    left = F.filter(pairs, lambda p: ~F.coalesce(F.array_contains(F.col("gone"), p["key"]), F.lit(False)))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda p: p["line"])))
    return rows.select(
        *((F.array_join("kept", "\n") if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in names),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
    )
