"""Date expressions; impossible parts give null, not an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_start(year_month: Column) -> Column:
    """Of text like 2023_04."""
    return F.try_to_timestamp(F.concat(F.replace(year_month, F.lit("_"), F.lit("-")), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")


def date_of(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date")


def hour_on_first(ts: Column, year: int = 2024, month: int = 1) -> Column:
    """The hour of ts on one reference day."""
    return F.make_timestamp_ntz(F.lit(year), F.lit(month), F.lit(1), F.hour(ts), F.lit(0), F.lit(0))


def months(spark: SparkSession, first: str, periods: int, name: str = "date") -> DataFrame:
    """`periods` month starts from `first`."""
    return spark.range(periods).select(F.add_months(F.lit(first).cast("date"), F.col("id").cast("int")).alias(name))


def on_or_after(year: Column, month: Column, y0: int, m0: int) -> Column:
    """A lower bound only."""
    return (year > y0) | ((year == y0) & (month >= m0))
