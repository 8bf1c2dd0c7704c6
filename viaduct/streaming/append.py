"""The feed: new points are appended to the history as they come, those without a value left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def feed(spark: SparkSession, path: str, schema: StructType | str, glob: str | None = None, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(path)


def append(stream: DataFrame, required: str, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Exactly-once append to Parquet; every: '2 seconds', or None to take what is there and end."""
    writer = stream.filter(F.col(required).isNotNull()).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(out)


def occupancy(stream: DataFrame, ts: str, key: str, value: str, width: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean value for each key and tumbling window, closed when the watermark has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
