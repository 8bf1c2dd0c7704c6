"""Expressions of the siting domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .text import literal_map


def without_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def grid_status(mw: Column, cfg: Config = DEFAULT) -> Column:
    """Null and NaN are congested."""
    c = without_nan(mw.cast("double"))
    return F.when(c >= cfg.sufficient_mw, "Sufficient").when(c >= cfg.moderate_mw, "Moderate").otherwise("Congested")


def is_friction(status: Column) -> Column:
    return F.coalesce(status.isin("Moderate", "Congested"), F.lit(False))


def chargers_needed(traffic: Column, cfg: Config = DEFAULT) -> Column:
    raw = F.ceil(traffic * F.lit(cfg.charging_probability) * F.lit(cfg.charge_hours) / F.lit(cfg.operating_hours))
    return F.least(F.greatest(raw, F.lit(cfg.min_chargers)), F.lit(cfg.max_chargers)).cast("int")


def spacing_km(trunk: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(trunk, cfg.trunk_spacing_km).otherwise(cfg.max_spacing_km)


def seasonal_multiplier(road: Column, month: Column, cfg: Config = DEFAULT) -> Column:
    peak = F.try_element_at(literal_map(cfg.peak_multipliers), road)
    return F.when(month.isin(*cfg.peak_months), F.coalesce(peak, F.lit(1.0))).otherwise(1.0)


def ev_traffic(imd: Column, fleet: Column, multiplier: Column, cfg: Config = DEFAULT) -> Column:
    return imd * (fleet / F.lit(cfg.fleet_size)) * multiplier


def demand_kw(chargers: Column, cfg: Config = DEFAULT) -> Column:
    return chargers * cfg.power_per_charger_kw


def co2_saving_t(vehicles: Column, cfg: Config = DEFAULT) -> Column:
    return vehicles * (cfg.co2_combustion_t - cfg.co2_electric_t)


def status_color(status: Column, cfg: Config = DEFAULT) -> Column:
    return F.try_element_at(literal_map(cfg.status_colors), status)
