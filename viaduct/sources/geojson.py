"""Feature collections of any size: one file is read by as many tasks as it has byte ranges, and written by as many as there are rows for.

Reading. The text source cuts files into ranges and ranges into chunks at each closing brace. Whether a chunk begins
inside a quoted string, how deep it stands, and how many objects ended before it are running sums: within a range by a
window, from range to range by a window over one row for each. Chunks between two ends of objects of depth two are one object.
No file is parsed as a whole, and no task holds more than a range's chunks, sorted, and one feature.

Writing. Features are numbered without being gathered and written in parts; the parts, in the order of their names, are
one valid document together: the first holds its head, the last its end, and every feature but the first begins with a comma.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import numbered
from ..operators.store import written

#: A quoted string, or the rest of one that goes on behind the chunk; what stands before the first brace outside of strings.
_STRING, _BEFORE = r'"(?:[^"\\]|\\.)*+"?', r'(?s)^(?:[^"{]|"(?:[^"\\]|\\.)*+")*+'
HEAD, END = '{"type": "FeatureCollection", "features": [', "]}"


def _many(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _tails(chunks: DataFrame) -> DataFrame:
    """(document, at, tail): the last chunk of each file that doesn't end in a brace, so that its bytes are one fewer than counted."""
    ranges = chunks.groupBy("document", "at", "size").agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.max("id").alias("tail"))
    w = Window.partitionBy("document", "at.name")
    last = F.col("at.block") == F.max("at.block").over(w)
    return ranges.withColumns({"last": last, "all": F.sum("bytes").over(w)}).filter(F.col("last") & (F.col("all") > F.col("size"))).select("document", "at", "tail")


def objects(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(document, number, value): the text of every object that stands in the outermost object or in a list of it.

    parts: the files of a folder are one document together, in the order of their names; otherwise each file is one.
    Braces, quotes and escapes inside of strings count for nothing."""
    raw = spark.read.option("lineSep", "}").text(path)
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    folder = F.regexp_replace(file, "/[^/]*$", "")
    at = F.struct((F.element_at(F.split(file, "/"), -1) if parts else F.lit("")).alias("name"), block.alias("block"))
    chunks = raw.select((folder if parts else file).alias("document"), at.alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"))
    quotes = _many(F.regexp_replace("text", r"\\.", ""), '"')

    def before(rows: DataFrame, what: Column, name: str) -> DataFrame:
        """A row for each range: the sum of `what` over all ranges of the document before it."""
        sums = rows.groupBy("document", "at").agg(F.sum(what).alias("s"))
        w = Window.partitionBy("document").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select("document", "at", F.coalesce(F.sum("s").over(w), F.lit(0)).alias(name))

    here = Window.partitionBy("document", "at").orderBy("id")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    # a cut inside of a string begins in one; the first scan only counts quotes and bytes
    placed = chunks.join(before(chunks, quotes, "quoted"), ["document", "at"]).join(_tails(chunks), ["document", "at"], "left").withColumn("quotes", quotes)
    placed = placed.withColumn("stop", F.when(F.col("id") == F.col("tail"), "").otherwise("}"))
    started = (F.col("quoted") + F.coalesce(F.sum("quotes").over(earlier), F.lit(0))) % 2
    placed = placed.withColumn("inside", started).withColumn("closes", F.when(F.col("stop") == "", 0).otherwise(1 - (F.col("inside") + F.col("quotes")) % 2))
    bare = F.regexp_replace(F.concat(F.when(F.col("inside") == 1, '"').otherwise(""), "text"), _STRING, "")
    deep = placed.withColumn("deeper", _many(bare, "{") - F.col("closes"))
    deep = written(deep.select("document", "at", "id", F.concat("text", "stop").alias("text"), "closes", "deeper", F.sum("deeper").over(here).alias("depth")), "chunks")
    deep = deep.join(before(deep, F.col("deeper"), "above"), ["document", "at"])
    ends = deep.select("document", "at", "id", "text", ((F.col("closes") == 1) & (F.col("above") + F.col("depth") == 1)).cast("int").alias("ends"))
    ends = ends.join(before(ends, F.col("ends"), "ended"), ["document", "at"])
    number = F.col("ended") + F.coalesce(F.sum("ends").over(earlier), F.lit(0))
    own = ends.withColumn("number", number).groupBy("document", "number").agg(F.max("ends").alias("ends"), F.sort_array(F.collect_list(F.struct("at", "id", "text"))).alias("c")).filter("ends = 1")
    text = F.array_join(F.transform("c", lambda c: c["text"]), "")
    inner = F.when(F.col("number") == 0, F.regexp_replace(text, _BEFORE + r"\{", "")).otherwise(text)
    return own.select("document", "number", F.regexp_replace(inner, _BEFORE, "").alias("value"))


def features(spark: SparkSession, path: str, geometry: str, properties: str, parts: bool = False) -> DataFrame:
    """A row for each feature of a collection: its properties as columns, then geometry_type and geometry (the coordinates).

    What isn't a feature is left out, but for objects with properties and no type; a feature without geometry has nulls there."""
    schema = f"type string, geometry struct<type string, coordinates {geometry}>, properties struct<{properties}>"
    f = objects(spark, path, parts).select(F.from_json("value", schema).alias("f")).filter("f.type = 'Feature' or (f.type is null and f.properties is not null)")
    return f.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("geometry"))


def write_collection(features: DataFrame, path: str, *order: str) -> None:
    """features (value, and the order's columns): one collection in parts, by the order's columns."""
    rows = numbered(features, "__n", *order)
    own = rows.select(F.col("__n"), F.concat(F.when(F.col("__n") > 0, ",").otherwise(""), "value").alias("value"))
    ends = rows.sparkSession.createDataFrame([(-1, HEAD), (2**62, END)], "__n long, value string")
    own.unionByName(ends).repartitionByRange("__n").sortWithinPartitions("__n").select("value").write.mode("overwrite").text(path)
