"""Contract checks: each gives the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..schemas import DISTRIBUTORS, FILE_1, FILE_2, FILE_3, FRICTION, STATUSES


class ContractError(ValueError):
    pass


def columns(df: DataFrame, want: list[str]) -> None:
    if df.columns != want:
        raise ContractError(f"columns {df.columns}, not {want}")


def violations(file_1: DataFrame, file_2: DataFrame, file_3: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(rule, row_id) of every row that breaks one."""
    for df, want in ((file_1, FILE_1), (file_2, FILE_2), (file_3, FILE_3)):
        columns(df, want)

    def bad(df: DataFrame, ident: str, rule: str, good) -> DataFrame:
        return df.filter(~F.coalesce(good, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(ident).cast("string").alias("row_id"))

    one = file_1.agg(F.count(F.lit(1)).alias("n")).filter("n <> 1").select(F.lit("file_1 has one row").alias("rule"), F.col("n").cast("string").alias("row_id"))
    chargers = file_2.select(F.col("location_id").alias("bottleneck_id"), "n_chargers_proposed")
    powered = file_3.join(chargers, "bottleneck_id", "left")
    parts = [
        one,
        bad(file_2, "location_id", "file_2 status in domain", F.col("grid_status").isin(STATUSES)),
        bad(file_3, "bottleneck_id", "file_3 status is friction", F.col("grid_status").isin(FRICTION)),
        bad(file_3, "bottleneck_id", "file_3 distributor in domain", F.col("distributor_network").isin(DISTRIBUTORS)),
        bad(powered, "bottleneck_id", "file_3 demand is chargers by power", F.col("estimated_demand_kw") == F.col("n_chargers_proposed") * cfg.power_per_charger_kw),
    ]
    return reduce(DataFrame.union, parts)


def require(file_1: DataFrame, file_2: DataFrame, file_3: DataFrame, cfg: Config = DEFAULT) -> None:
    found = violations(file_1, file_2, file_3, cfg).limit(5).collect()
    if found:
        raise ContractError(f"contract broken: {[tuple(r) for r in found]}")
