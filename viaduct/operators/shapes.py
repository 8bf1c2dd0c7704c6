"""Lines and polygons as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges_of_lines(lines: DataFrame, ident: str, path: str) -> DataFrame:
    """(ident, edge_no, x1, y1, x2, y2) of paths array<array<double>>; edges without length are left out."""
    rows = lines.select(ident, F.col(path).alias("p")).filter(F.size("p") >= 2)
    rows = rows.select(ident, "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("edge_no"))
    a, b = F.get(F.col("p"), F.col("edge_no")), F.get(F.col("p"), F.col("edge_no") + 1)
    out = rows.select(ident, "edge_no", F.get(a, F.lit(0)).alias("x1"), F.get(a, F.lit(1)).alias("y1"), F.get(b, F.lit(0)).alias("x2"), F.get(b, F.lit(1)).alias("y2"))
    return out.filter("x1 <> x2 or y1 <> y2")


def edges_of_polygons(polygons: DataFrame, ident: str, rings: str) -> DataFrame:
    """Edges of all rings array<array<array<double>>>; rings of fewer than four points are left out."""
    flat = polygons.select(ident, F.explode(rings).alias("ring")).filter(F.size("ring") >= 4)
    return edges_of_lines(flat, ident, "ring")


def centroids(edges: DataFrame, ident: str) -> DataFrame:
    """(ident, x, y): mean of the edges' midpoints, weighted by length."""
    length = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    e = edges.withColumn("l", length)
    total = F.sum("l")
    return e.groupBy(ident).agg(F.try_divide(F.sum(F.col("l") * (F.col("x1") + F.col("x2")) / 2), total).alias("x"), F.try_divide(F.sum(F.col("l") * (F.col("y1") + F.col("y2")) / 2), total).alias("y"))
