"""Unit-root test, seasonal models, projection, stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.forecast import apply as fc
from viaduct.forecast.adf import adf, p_value
from viaduct.forecast.sarima import Sarima, auto_sarima
from viaduct.functions import dates
from viaduct.streaming import append as st


def seasonal(n=108, seed=0):
    rng = np.random.default_rng(seed)
    k = np.arange(n)
    return 8 + 0.02 * k + 0.2 * np.sin(2 * np.pi * k / 12) + rng.normal(0, 0.03, n)


def test_adf():
    rng = np.random.default_rng(1)
    assert all(adf(rng.normal(size=200))[1] < 0.01 for _ in range(20))
    assert sum(adf(np.cumsum(rng.normal(size=200)))[1] < 0.05 for _ in range(40)) <= 6
    assert p_value(-2.86) == pytest.approx(0.05, abs=0.003) and p_value(-3.43) == pytest.approx(0.01, abs=0.002)
    assert adf(np.ones(20))[1] == 1.0
    with pytest.raises(ValueError):
        adf(np.ones(3))


def test_ar_model_finds_its_coefficient():
    rng = np.random.default_rng(2)
    y = [0.0]
    for e in rng.normal(size=600):
        y.append(0.7 * y[-1] + e)
    m = Sarima((1, 0, 0), drift=True).fit(np.array(y))
    assert m._coef(m.params)[0][0] == pytest.approx(0.7, abs=0.08) and m.sigma2 == pytest.approx(1.0, abs=0.15)
    mean, low, high = m.forecast(30, 0.5)
    assert (low < mean).all() and (mean < high).all() and high[-1] - low[-1] > high[0] - low[0]


def test_auto_model_follows_trend_and_season():
    y = seasonal(120)
    m = auto_sarima(y[:108])
    assert np.abs(m.forecast(12)[0] - y[108:]).max() < 0.25


def test_forecast_per_series(spark):
    rows = [(s, d.date, int(np.exp(v))) for s in ("a", "b") for d, v in zip(dates.months(spark, "2015-01-01", 108).collect(), seasonal(seed=ord(s)), strict=True)]
    df = spark.createDataFrame(rows, "series string, date date, n long")
    out = fc.forecast(df, "series", "date", "n", 12, (1, 0, 0), (1, 1, 0), level=0.5)
    got = out.collect()
    assert len(got) == 24 and {str(r["date"]) for r in got if r["series"] == "a"} >= {"2024-01-01", "2024-12-01"}
    assert all(r["low"] <= r["mean"] <= r["high"] for r in got)
    assert fc.adf_test(df, "series", "date", "n").count() == 2
    actual = df.filter("series = 'a'").select("date", F.col("n").alias("ev_registrations"))
    p = fc.projection(actual, out.filter("series = 'a'").select("date", F.col("mean").alias("ev_registrations")))
    rows = sorted(p.collect(), key=lambda r: r["date"])
    assert rows[-1]["cumulative_ev_fleet"] == sum(r["ev_registrations"] for r in rows) and len(rows) == 120
    assert fc.fleet_total(p).first()[0] == rows[-1]["cumulative_ev_fleet"]


def test_values_below_one_are_refused(spark):
    df = spark.createDataFrame([("a", d.date, 0) for d in dates.months(spark, "2015-01-01", 30).collect()], "series string, date date, n long")
    with pytest.raises(Exception, match="logs need values above 0"):
        fc.forecast(df, "series", "date", "n", 3).collect()


def test_stream_equals_batch(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select("id", F.when(F.col("id") % 3 != 0, F.col("id") * 1.0).alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = st.feed(spark, str(tmp_path / "in"), "id long, v double", files_at_once=1)
    st.append(s, "v", str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    st.append(s, "v", str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()  # nothing new, nothing twice
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_occupancy_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:30' AS ts, 'p' AS k, 1.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:01:30', 'p', 3.0D UNION ALL SELECT timestamp'2024-01-01 02:00:00', 'p', 9.0D").write.parquet(str(tmp_path / "in"))
    s = st.occupancy(st.feed(spark, str(tmp_path / "in"), "ts timestamp, k string, v double"), "ts", "k", "v")
    q = s.writeStream.format("memory").queryName("occ").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["mean_value"], r["n"]) for r in spark.sql("SELECT * FROM occ").collect()] == [(2.0, 2)]
