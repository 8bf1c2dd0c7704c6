"""Model fits as DataFrame operators: one series a group, whole models in Python, all else in the plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .adf import adf
from .sarima import Sarima, auto_sarima


def adf_test(df: DataFrame, series: str, date: str, value: str, log: bool = True) -> DataFrame:
    """(series, statistic, p_value, stationary) of each series' (logged) values."""
    kind = df.schema[series].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _values(pdf, date, value, log)
        stat, p, _ = adf(y)
        return pd.DataFrame({series: [pdf[series].iloc[0]], "statistic": [stat], "p_value": [p], "stationary": [p < 0.05]})

    return df.select(series, date, value).groupBy(series).applyInPandas(run, f"{series} {kind}, statistic double, p_value double, stationary boolean")


def _values(pdf: pd.DataFrame, date: str, value: str, log: bool) -> np.ndarray:
    y = pdf.sort_values(date)[value].to_numpy(float)
    if log and (y <= 0).any():
        raise ValueError("logs need values above 0")
    return np.log(y) if log else y


def forecast(df: DataFrame, series: str, date: str, value: str, periods: int, order: tuple | None = None, seasonal: tuple = (0, 0, 0), m: int = 12, level: float = 0.95, log: bool = True) -> DataFrame:
    """(series, date, mean, low, high): the next months of each monthly series; order None searches one."""
    kind = df.schema[series].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _values(pdf, date, value, log)
        model = Sarima(tuple(order), tuple(seasonal), m, drift=order[1] + seasonal[1] <= 1).fit(y) if order else auto_sarima(y, m)
        out = model.forecast(periods, level)
        if log:
            out = [np.exp(np.minimum(x, 700)) for x in out]
        first = pd.Timestamp(pdf[date].max()) + pd.offsets.MonthBegin(1)
        dates = pd.date_range(first, periods=periods, freq="MS").date
        return pd.DataFrame({series: pdf[series].iloc[0], "date": dates, "mean": out[0], "low": out[1], "high": out[2]})

    return df.select(series, date, value).groupBy(series).applyInPandas(run, f"{series} {kind}, date date, mean double, low double, high double")


def projection(actual: DataFrame, ahead: DataFrame) -> DataFrame:
    """(date, ev_registrations, type, cumulative_ev_fleet): history, then whole forecasts, and their running total."""
    both = actual.select("date", F.col("ev_registrations").cast("bigint").alias("ev_registrations"), F.lit("actual").alias("type"))
    both = both.unionByName(ahead.select("date", F.col("ev_registrations").cast("bigint").alias("ev_registrations"), F.lit("forecast").alias("type")))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("cumulative_ev_fleet", F.sum("ev_registrations").over(w))


def fleet_total(projected: DataFrame) -> DataFrame:
    """(total_ev_projected): the running total at the last date."""
    return projected.agg(F.max_by("cumulative_ev_fleet", "date").alias("total_ev_projected"))
