"""Monthly series, forecasts and the append stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..forecast import apply as fc
from ..functions import dates
from ..operators.store import shared_dir
from ..pipelines import fleet
from ..streaming import append as st
from .registry import query, t


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("date")).agg(F.count(F.lit(1)).alias("ev_registrations"))
    return m.select(F.lit("all").alias("series"), "date", "ev_registrations")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, count(*) AS ev_registrations FROM orders GROUP BY 1),
f AS (SELECT (date '2001-09-01' + to_months(i::INTEGER))::DATE AS date, 100 + 3 * i AS ev_registrations FROM (SELECT unnest(range(0, 48)) AS i)),
b AS (SELECT date, ev_registrations, 'actual' AS type FROM m UNION ALL SELECT date, ev_registrations, 'forecast' FROM f)
SELECT strftime(date, '%Y-%m-%d') AS date, ev_registrations, type, sum(ev_registrations) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative_ev_fleet FROM b""")
def projection_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d).withColumn("date", F.col("date").cast("string"))


def _projected(spark: SparkSession, d: str) -> DataFrame:
    ahead = dates.months(spark, "2001-09-01", 48).withColumn("ev_registrations", 100 + 3 * F.months_between("date", F.lit("2001-09-01")).cast("bigint"))
    return fc.projection(_monthly(spark, d), ahead)


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, count(*) AS n FROM orders GROUP BY 1) SELECT sum(n)::BIGINT + (SELECT sum(100 + 3 * i)::BIGINT FROM (SELECT unnest(range(0, 48)) AS i)) AS total_ev_projected FROM m""")
def projection_total(spark: SparkSession, d: str) -> DataFrame:
    return fc.fleet_total(_projected(spark, d))


@query("""SELECT 2001 + (8 + i) // 12 AS year, sum(100 + 3 * i)::BIGINT AS registrations FROM (SELECT unnest(range(0, 48)) AS i) GROUP BY 1""")
def projection_by_year(spark: SparkSession, d: str) -> DataFrame:
    p = _projected(spark, d).filter("type = 'forecast'")
    return p.groupBy(F.year("date").cast("bigint").alias("year")).agg(F.sum("ev_registrations").alias("registrations"))


@query()
def adf_test(spark: SparkSession, d: str) -> DataFrame:
    return fc.adf_test(_monthly(spark, d), "series", "date", "ev_registrations")


@query()
def sarima_forecast(spark: SparkSession, d: str) -> DataFrame:
    return fc.forecast(_monthly(spark, d), "series", "date", "ev_registrations", 12, (1, 0, 2), (1, 0, 1), level=0.5)


@query()
def auto_sarima(spark: SparkSession, d: str) -> DataFrame:
    return fc.forecast(_monthly(spark, d), "series", "date", "ev_registrations", 48)


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS date, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT sum(exp(ln(n) * 1.01::DOUBLE)) AS mean FROM m)
SELECT CAST(round_even(mean, 0) AS BIGINT) AS vehicles, CAST(round_even(mean, 0) AS BIGINT) * 16 AS co2_saving_t FROM f""")
def forecast_co2(spark: SparkSession, d: str) -> DataFrame:
    """Vehicles as the rounded sum of what monthly logarithms, one hundredth higher, amount to, and the carbon dioxide that they save."""
    return fleet.co2(_monthly(spark, d).select(F.exp(F.log("ev_registrations") * 1.01).alias("mean")))


@query("SELECT event_id, value FROM events WHERE event_id % 7 <> 0")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """The events as a file stream, a seventh without a value, appended until nothing is left.

    The path is a pattern, as a stream takes a single file by a pattern only."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = st.feed(spark, f"{d}/event[s].parquet", t(spark, d, "events").schema)
    rows = source.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    st.append(rows, "value", f"{base}/out", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("""WITH e AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-20 00:00:00' OR event_id % 11 = 0 THEN 2 ELSE 1 END AS run, time_bucket(INTERVAL '6 hours', ts) AS opens FROM events),
w AS (SELECT date_trunc('milliseconds', max(ts) FILTER (WHERE run = 1)) - INTERVAL 12 HOUR AS first, date_trunc('milliseconds', max(ts)) - INTERVAL 12 HOUR AS last FROM e)
SELECT event_type, strftime(opens, '%Y-%m-%d %H:%M:%S') AS window_start, round(avg(value), 6) AS mean_value, count(*) AS n FROM e, w
WHERE (run = 1 OR opens + INTERVAL 6 HOUR > first) AND opens + INTERVAL 6 HOUR <= last GROUP BY 1, 2""")
def occupancy_windows(spark: SparkSession, d: str) -> DataFrame:
    """Means by event-time windows of a feed that is stopped and restarted from its checkpoint; what comes too late is left out.

    The first run sees the events before a day but for every eleventh; the second one sees those and all later ones, and takes
    late rows only for windows that the watermark, as the first run left it, has not closed."""
    base = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    # the clock of the table as an instant, whatever the session's time zone is
    ts = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts")))
    events = t(spark, d, "events").select("event_id", ts.alias("ts"), "event_type", "value", (F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))).alias("second"))
    later = F.col("second") | (F.col("event_id") % 11 == 0)
    for run in (~later, later):
        events.filter(run).drop("second").write.mode("append").parquet(f"{base}/in")
        windows = st.occupancy(st.feed(spark, f"{base}/in", events.drop("second").schema), "ts", "event_type", "value", "6 hours", "12 hours")
        out = windows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/log").trigger(availableNow=True)
        out.start(f"{base}/out").awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.select("event_type", F.date_format(F.to_utc_timestamp("window.start", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.round("mean_value", 6).alias("mean_value"), "n")
