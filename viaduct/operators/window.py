"""Window operators: imputation, running totals, moving averages, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .store import written


def impute_median(df: DataFrame, group: str, column: str, out: str) -> DataFrame:
    """Nulls take their group's median, then the median of the column so filled; both exact, by selection. Rows are written once, as each pass reads them."""
    df = written(df, "rows")
    medians = quantiles(df, column, [0.5], [group]).select(F.col(group).alias("__g"), F.col("q")[0].alias("__m"))
    filled = df.join(medians, df[group].eqNullSafe(F.col("__g")), "left").drop("__g")
    filled = filled.withColumn(out, F.coalesce(F.col(column), F.col("__m"))).drop("__m")
    whole = quantiles(filled, out, [0.5]).agg(F.first(F.col("q")[0]).alias("__all"))  # one row, also of nothing
    return filled.crossJoin(F.broadcast(whole)).withColumn(out, F.coalesce(F.col(out), F.col("__all"))).drop("__all")


def running_total(df: DataFrame, value: str, out: str, *order: str) -> DataFrame:
    """Meant for short series (months, hours): without a key the rows meet in one task."""
    return df.withColumn(out, F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def centred_average(df: DataFrame, value: str, out: str, *order: str, size: int = 12, least: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of `size` rows around each (an even window reaches one row further back), null below `least` values."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size // 2), (size - 1) // 2)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def duplicated(df: DataFrame, *key: str) -> DataFrame:
    """All rows whose key occurs more than once."""
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return df.join(twice, list(key), "left_semi")
