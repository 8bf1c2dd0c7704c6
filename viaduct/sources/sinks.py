"""Writers: contract files, GeoJSON, JSON records, latin-1 CSV, partitioned Parquet, map layers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domain import status_color
from . import geojson


def csv(df: DataFrame, path: str, encoding: str = "UTF-8", single: bool = False, most: int = 1_000_000) -> None:
    """single: one file, for the small contract tables; more than `most` rows are refused, as one task would write them all."""
    if single and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for a single file")
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)


def features(df: DataFrame, kind: str, geometry: str, keep: list[str] | None = None) -> DataFrame:
    """(value, kept columns): a GeoJSON feature as a line of text for each row; all other columns than the geometry are its properties."""
    props = F.struct(*(F.col(c) for c in df.columns if c != geometry))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), F.col(geometry).alias("coordinates")).alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"}).alias("value"), *(keep or []))


def geojson_lines(df: DataFrame, path: str, kind: str, geometry: str) -> None:
    """Newline-delimited features, written in parallel."""
    features(df, kind, geometry).write.mode("overwrite").text(path)


def geojson_collection(df: DataFrame, path: str, kind: str, geometry: str, *order: str) -> None:
    """One FeatureCollection in the order of some properties, written in parallel: the parts, by name, are the document."""
    rows = features(df, kind, geometry, list(order))
    geojson.write_collection(rows, path, *order)


def json_records(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON records with ISO dates; `by`: a folder for each value, the column stays in the records."""
    opt = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
    if by:
        df.withColumn("part", F.col(by)).write.mode("overwrite").partitionBy("part").options(**opt).json(path)
    else:
        df.write.mode("overwrite").options(**opt).json(path)


def monthly_parquet(df: DataFrame, path: str, year: str, month: str) -> None:
    df.write.mode("overwrite").partitionBy(year, month).parquet(path)


def map_layer(df: DataFrame, lat: str = "latitude", lon: str = "longitude", status: str = "grid_status") -> DataFrame:
    """Points with a colour and a popup text."""
    popup = F.concat_ws("; ", *(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in df.columns if c not in (lat, lon)))
    return df.withColumns({"color": status_color(F.col(status)), "popup": popup})


def map_html(layer: DataFrame, most: int = 20_000) -> str:
    """A page that draws the points on a canvas, without any outside file."""
    rows = layer.select("longitude", "latitude", "color", "popup").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} points")
    points = json.dumps([list(r) for r in rows], ensure_ascii=False).replace("<", "\\u003c")
    return f"<!doctype html><meta charset=utf-8><canvas id=m width=1000 height=800></canvas><script>const p={points},c=m.getContext('2d'),x=p.map(q=>q[0]),y=p.map(q=>q[1]),a=Math.min(...x),b=Math.max(...x),d=Math.min(...y),e=Math.max(...y);p.forEach(q=>{{c.fillStyle=q[2];c.beginPath();c.arc(20+960*(q[0]-a)/((b-a)||1),780-760*(q[1]-d)/((e-d)||1),4,0,7);c.fill()}});m.title=p.length+' points'</script>"
