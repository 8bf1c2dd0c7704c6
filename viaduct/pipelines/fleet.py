"""From vehicle registrations to the projected fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..forecast import apply as fc
from ..functions import dates, domain, text
from ..operators import aggregate as ag
from ..schemas import PROPULSION


def clean_registrations(df: DataFrame, first: tuple[int, int] = (2015, 1), kinds: tuple[str, ...] = ("40",), firm: tuple[str, ...] = ("1", "5", "B")) -> DataFrame:
    """Firm registrations of passenger cars from a month on, with ano, mes and propulsion in words; unknown codes go.

    There is a lower bound only. Unreadable dates count as year 0 and so fall out."""
    day = F.col("FEC_MATRICULA")

    def part(c: Column) -> Column:
        return F.coalesce(c.try_cast("int"), F.lit(0))

    kept = df.filter(F.col("COD_TIPO").isin(*kinds) & F.col("CLAVE_TRAMITE").isin(*firm))
    out = kept.withColumns({"ano": part(text.from_right(day, 4, 4)), "mes": part(text.from_right(day, 6, 2)), "propulsion": F.try_element_at(text.literal_map(PROPULSION), F.col("COD_PROPULSION_ITV"))})
    return out.filter(dates.on_or_after(F.col("ano"), F.col("mes"), *first) & F.col("propulsion").isNotNull())


def top_brands(clean: DataFrame, year: int, k: int = 10, by: tuple[str, ...] = ("MARCA_ITV",), propulsion: str | None = None) -> DataFrame:
    rows = clean.filter(F.col("ano") == year)
    if propulsion:
        rows = rows.filter(F.col("propulsion") == propulsion)
    return ag.top_k(ag.value_counts(rows, *by, name="matriculaciones"), k, "matriculaciones", *by)


def market_share(clean: DataFrame, year: int, keep: tuple[str, ...] = ("Gasolina", "Diesel", "Eléctrico")) -> DataFrame:
    """(propulsion, matriculaciones, pct) with all other kinds as one."""
    rows = clean.filter(F.col("ano") == year).select(ag.other_bucket(F.col("propulsion"), list(keep)).alias("propulsion"))
    n = rows.groupBy("propulsion").agg(F.count(F.lit(1)).alias("matriculaciones"))
    whole = n.agg(F.sum("matriculaciones").alias("whole"))  # one row
    return n.crossJoin(F.broadcast(whole)).select("propulsion", "matriculaciones", (F.try_divide(F.col("matriculaciones"), F.col("whole")) * 100).alias("pct"))


def monthly_by_kind(clean: DataFrame, keep: tuple[str, ...] = ("Gasolina", "Diesel", "Eléctrico")) -> DataFrame:
    """A row for each month with a column for each kind, their total and their shares."""
    kinds = [*keep, "Otros"]
    n = clean.select("ano", "mes", ag.other_bucket(F.col("propulsion"), list(keep)).alias("p")).groupBy("ano", "mes", "p").agg(F.count(F.lit(1)).alias("n"))
    return ag.shares(ag.pivot_sum(n, ["ano", "mes"], "p", kinds, "n"), kinds)


def heat_map(clean: DataFrame, years: list[int], electric: bool) -> DataFrame:
    """Months by years: counts of electric cars, or of all others."""
    own = (F.col("propulsion") == "Eléctrico") == F.lit(electric)
    n = clean.filter(own).groupBy("mes", "ano").agg(F.count(F.lit(1)).alias("n"))
    p = ag.pivot_sum(n, ["mes"], "ano", years, "n")
    return p.select("mes", *(F.col(str(y)).cast("double").alias(str(y)) for y in years))


def electric_series(clean: DataFrame) -> DataFrame:
    """(series, date, ev_registrations) of electric cars by month."""
    n = clean.filter("propulsion = 'Eléctrico'").groupBy("ano", "mes").agg(F.count(F.lit(1)).alias("ev_registrations"))
    return n.select(F.lit("all").alias("series"), dates.date_of(F.col("ano"), F.col("mes"), F.lit(1)).alias("date"), "ev_registrations")


def project(monthly: DataFrame, periods: int = 48, level: float = 0.95) -> DataFrame:
    """History and forecast with the running fleet, from (date, ev_registrations)."""
    series = monthly.select(F.lit("all").alias("series"), "date", "ev_registrations")
    ahead = fc.forecast(series, "series", "date", "ev_registrations", periods, level=level)
    return fc.projection(monthly, ahead.select("date", F.col("mean").alias("ev_registrations")))


def co2(ahead: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(vehicles, co2_saving_t) of a forecast's means."""
    n = ahead.agg(F.bround(F.sum("mean")).cast("bigint").alias("vehicles"))
    return n.withColumn("co2_saving_t", domain.co2_saving_t(F.col("vehicles"), cfg))
