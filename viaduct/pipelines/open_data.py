"""Smaller open-data exercises: accidents by hour and place, toxicology ratios, reservoirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import aggregate as ag
from ..operators import joins, window

NAMES = {"ANYO": "year", "MES": "month", "DIA_SEMANA": "day", "HORA": "hour"}


def by_weekday_hour(accidents: DataFrame, victims: str = "TOTAL_VICTIMAS_24H", year: int = 2024, month: int = 1) -> DataFrame:
    """(index, date, victims, VICTIMAS_acc, dayz): victims for each weekday and hour and their running sum over the week.

    A slot with a single accident is left out, which is the defined behaviour; weekday n is day n of the reference month."""
    a = accidents.withColumnsRenamed(NAMES)
    slot = F.make_timestamp_ntz(F.lit(year), F.lit(month), F.col("day"), F.col("hour"), F.lit(0), F.lit(0))
    rows = a.filter(F.col("day").between(1, 7) & F.col("hour").between(0, 23)).select(slot.alias("date"), F.col("day").cast("string").alias("dayz"), F.col(victims).alias(victims))
    sums = window.duplicated(rows, "date").groupBy("dayz", "date").agg(F.sum(victims).alias(victims))
    return joins.numbered(window.running_total(sums, victims, "VICTIMAS_acc", "dayz", "date"), "index", "dayz", "date").select("index", "date", victims, "VICTIMAS_acc", "dayz")


def envelope(weekly: DataFrame, victims: str = "TOTAL_VICTIMAS_24H") -> DataFrame:
    """Least and greatest sums for each hour, whatever the weekday."""
    return weekly.groupBy(dates.hour_on_first(F.col("date")).alias("date")).agg(F.min(victims).alias("min_victims"), F.max(victims).alias("max_victims"))


def category_counts(accidents: DataFrame, category: str) -> DataFrame:
    """(index, category, count), most frequent first; missing categories are left out."""
    n = ag.value_counts(accidents, category)
    return joins.numbered(n, "index", F.col("count").desc(), category).select("index", category, "count")


def by_municipality(accidents: DataFrame, places: DataFrame, code: str = "COD_MUNICIPIO", place: str = "MUNIINE", prefix: str = "46") -> DataFrame:
    """(place, count) of a province's municipalities, 0 where nothing happened."""
    c = text.zero_padded(text.strip(F.col(code)), 5)
    n = ag.value_counts(accidents.select(c.alias(place)).filter(F.col(place).startswith(prefix)), place)
    return joins.zero_filled(places.filter(F.col(place).startswith(prefix)).select(place).distinct(), n, place, "count")


def positives_by_fleet(positives: DataFrame, fleet: DataFrame, key: str, fleet_key: str, positive: str = "Resultado positivo", size: str = "Total") -> DataFrame:
    """Positives with the group's fleet (`Parque`) and their `Ratio`; names are compared in lower case."""
    total = fleet.groupBy(F.lower(fleet_key).alias("__k")).agg(F.sum(size).alias("Parque"))
    return positives.join(total, F.lower(key) == F.col("__k")).drop("__k").withColumn("Ratio", F.try_divide(F.col(positive), F.col("Parque")))


def ten_year_means(levels: DataFrame, basin: str, reservoir: str, value: str, out: str) -> DataFrame:
    return levels.groupBy(basin, reservoir).agg(F.bround(F.avg(value), 2).alias(out))


def seasonal_multipliers(months: DataFrame) -> DataFrame:
    """Occupancy of the month over that of the year, which is given and not the mean of the months."""
    return months.withColumn("seasonal_multiplier", F.round(F.try_divide(F.col("occupancy_rate_pct"), F.col("annual_occupancy_rate_pct")), 4))
