"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch that are Python strings at the same time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, all other characters as they are. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the documents, from which no label is learned; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one below the warehouse on a single machine, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return at.rstrip("/")


def materialised(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again: the lineage ends there, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def over_texts(df: DataFrame, id_col: str, text_col: str, schema: str, names: list[str], make: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """One row out for each row in: the id under its own name, then what make()(text) returns, in the order of names.

    make is called once in each task; texts become Python strings SLICE at a time, so memory follows the longest SLICE texts, not the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [one(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), type=k) for c, k in zip(zip(*rows, strict=True), types, strict=True))], [id_col, *names])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)
    types = [to_arrow_type(f.dataType) for f in fields]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


class Memo(dict):
    """Values of a pure function, in two generations: the newest `cap` at least, `2 * cap` at most. Keys beyond LONG aren't kept, so memory is bounded."""

    LONG = 64

    def __init__(self, of: Callable, cap: int = 120_000):
        super().__init__()
        self.of, self.cap, self.old = of, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
            if len(key) > self.LONG:
                return value
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
