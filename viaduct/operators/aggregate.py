"""Grouped and global aggregates, pivots, cross-tabs, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def value_counts(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Counts by key, nulls left out."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top_k(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k rows with the largest `by`; ties go by the other columns, ascending."""
    return df.orderBy(F.col(by).desc(), *ties).limit(k)


def cents(c: Column) -> Column:
    """Money as whole cents, so that sums don't depend on their order."""
    return F.round(c * 100).cast("bigint")


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, std (sample), min, quartiles (linear), max; exact, the quartiles by selection."""
    q = quantiles(df, column, [0.25, 0.5, 0.75]).agg(F.first("q").alias("q"))  # one row, also of nothing
    out = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    return out.crossJoin(F.broadcast(q)).select("count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def crosstab_margins(df: DataFrame, row: str, column: str, values: list, total: str = "All") -> DataFrame:
    """Counts of row x column, with a total row and a total column."""
    cube = df.na.drop(subset=[row, column]).cube(row, column).agg(F.count(F.lit(1)).alias("n"), F.grouping(row).alias("gr"), F.grouping(column).alias("gc"))
    cube = cube.select(F.when(F.col("gr") == 1, total).otherwise(F.col(row).cast("string")).alias(row), F.when(F.col("gc") == 1, total).otherwise(F.col(column).cast("string")).alias(column), "n")
    return cube.groupBy(row).pivot(column, [*map(str, values), total]).agg(F.sum("n")).na.fill(0)


def pivot_sum(df: DataFrame, index: list[str], column: str, values: list, value: str) -> DataFrame:
    """Sums of value, a column for each of the given values, 0 where there is none."""
    return df.groupBy(*index).pivot(column, values).agg(F.sum(value)).na.fill(0)


def other_bucket(c: Column, keep: list[str], other: str = "Otros") -> Column:
    """Listed values stay; all else, null too, is `other`."""
    return F.when(c.isin(*keep), c).otherwise(other)


def shares(df: DataFrame, columns: list[str], total: str = "TOTAL") -> DataFrame:
    """Row-wise total and each column's percentage of it."""
    whole = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.withColumn(total, whole).withColumns({f"{c}_pct": F.try_divide(F.col(c), F.col(total)) * 100 for c in columns})


def first_and_max(df: DataFrame, key: str, first: list[str], largest: list[str], order: str) -> DataFrame:
    """By key: the first non-null value in the given order of some columns, the maximum of others."""
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return df.groupBy(key).agg(*firsts, *(F.max(c).alias(c) for c in largest))


def distinct_first(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def hour_envelope(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Least and greatest value for each hour of the day."""
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))
