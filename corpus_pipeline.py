"""The corpus pipeline: quality, repeated lines, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
their input. Every stage decides by row: rows with a null or a repeated doc_id are decided like any other, exactly repeated rows
are copies of each other, null texts count as empty, and an empty table stays empty. Other columns are carried and never read,
but for `n_chars`, which `lines` brings up to date where there is such a column.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.bpe import encode_texts
from viaduct.llm.common import materialised, shared_dir, table
from viaduct.llm.decontam import leaks
from viaduct.llm.line_dedup import line_dedup
from viaduct.llm.near_dup import simhash_groups
from viaduct.llm.queries import tokenizer
from viaduct.llm.quality import keep_good, train


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc): every row under a key of its own, fixed by being written."""
    return materialised(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "keyed")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores at least 0.3; null and empty texts have the score of the bias alone. Without labels all are kept at 0.5."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")), 0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document; a line of 40 characters or more that stands in five rows or more stays only in the one with the largest doc_id.

    Null texts become empty. Rows that tie on that doc_id all keep the line; a null id is below every other."""
    out = line_dedup(docs)
    return out.select(*(F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: SimHash candidates with at least 0.8 of their shingles of five words in common.

    Ids tie by the row's place in the table as written; a null id is above every other. Texts without words are one group."""
    rows = keyed(docs)
    texts = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    found = materialised(simhash_groups(texts), "groups").join(texts.select("row", "doc_id"), "row")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept"), F.count(F.lit(1)).alias("n"))
    dropped = found.join(first.filter("n > 1"), "component").filter("row <> kept.row").select("row")
    return rows.join(dropped, "row", "left_anti").select("doc.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    rows = keyed(docs)
    texts = rows.select("row", F.col("doc.text").alias("text"))
    found = leaks(texts, table(spark, sf_dir, "benchmark"), id_col="row").select(F.col("doc_id").alias("row")).distinct()
    return rows.join(found, "row", "left_anti").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left, one row for each; null counts as empty."""
    out = encode_texts(docs, tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]

#: Trained scores, fingerprints and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{k}-{name}")
    return docs
