"""Published pairs of inputs and outputs: registrations and their projection, a grid operator's statistics, hotel occupancy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.forecast import apply as fc
from viaduct.forecast.sarima import auto_sarima, needs_seasonal_difference
from viaduct.functions import dates
from viaduct.functions.rounding import hundredths
from viaduct.sources import readers

# Registrations of electric cars by month, nine years from 2015 on, a year in a row.
REGISTERED = [
    109, 140, 229, 163, 163, 200, 329, 150, 261, 477, 348, 239,
    298, 334, 653, 539, 575, 390, 422, 238, 432, 413, 650, 662,
    407, 463, 653, 756, 755, 901, 1122, 1068, 1318, 1895, 1412, 1568,
    1649, 1118, 1878, 1317, 1460, 2244, 1491, 1109, 2039, 1915, 2034, 3194,
    1960, 2179, 2881, 1949, 2650, 3278, 3238, 1321, 2443, 2728, 4018, 3216,
    4347, 4392, 2760, 509, 2928, 3414, 5691, 3348, 5286, 5531, 6099, 11910,
    2553, 3930, 7074, 6001, 7588, 9378, 7024, 4958, 8172, 7940, 8683, 10237,
    6828, 7818, 8480, 7614, 8516, 9503, 7766, 5730, 9189, 8449, 10152, 10186,
    8999, 10155, 12803, 9892, 13370, 14463, 11121, 9043, 10385, 13806, 14390, 14701,
]
#: Their sum, the published fleet after 48 more months, and the published totals of these four years (fixed values).
SO_FAR, FLEET, YEARS = 457153, 2498159, (221594, 353616, 564165, 901631)
# Demand by month as published, in full and rounded; installed capacity, its share, both rounded.
DEMAND = [('2024-01', 22353571.734000005, 22353571.73), ('2024-02', 20335524.43099999, 20335524.43), ('2024-03', 20714646.058000006, 20714646.06), ('2024-04', 19297307.064999998, 19297307.06), ('2024-05', 19541304.511000007, 19541304.51), ('2024-06', 19647475.567000017, 19647475.57), ('2024-07', 22776696.191000003, 22776696.19), ('2024-08', 22457895.43399998, 22457895.43), ('2024-09', 19951121.613, 19951121.61), ('2024-10', 20340919.00899997, 20340919.01), ('2024-11', 19908555.216, 19908555.22), ('2024-12', 21674632.329999983, 21674632.33)]
CAPACITY = [('Hydro', 17096.396, 0.12557345547933574, 17096.4, 0.13), ('Nuclear', 7117.29, 0.052276672753048155, 7117.29, 0.05), ('Coal', 2061.175, 0.015139381837997895, 2061.18, 0.02), ('Fuel + Gas', 7.95, 5.839294849398196e-05, 7.95, 0.0), ('Diesel engines', 768.67, 0.005645900341996114, 768.67, 0.01), ('Gas turbine', 1148.65, 0.00843686292925942, 1148.65, 0.01), ('Steam turbine', 482.64, 0.0035450028504572894, 482.64, 0.0), ('Combined cycle', 26250.145, 0.19280797043327774, 26250.15, 0.19), ('Hydroeolian', 11.32, 8.314568263545607e-05, 11.32, 0.0), ('Wind', 32128.571, 0.23598515617462168, 32128.57, 0.24), ('Solar photovoltaic', 39472.963, 0.28992989878790637, 39472.96, 0.29), ('Thermal solar', 2303.072, 0.01691612134263296, 2303.07, 0.02), ('Other renewables', 1115.628, 0.008194315514772843, 1115.63, 0.01), ('Cogeneration', 5586.225, 0.04103096210072885, 5586.23, 0.04), ('Non-renewable waste', 425.766, 0.003127261900438833, 425.77, 0.0), ('Renewable waste', 170.115, 0.001249498922396697, 170.12, 0.0), ('Total capacity', 136146.576, 1, 136146.58, 1.0)]
# Occupancy of a province by month, of its year, and their ratio.
OCCUPANCY, YEAR, MULTIPLIER = [20.64, 32.83, 30.56, 36.17, 37.55, 38.18, 46.12, 39.56, 40.87, 52.71, 33.52, 24.11], 36.45, [0.5663, 0.9007, 0.8384, 0.9923, 1.0302, 1.0475, 1.2653, 1.0853, 1.1213, 1.4461, 0.9196, 0.6615]


def monthly(spark):
    days = [r.date for r in dates.months(spark, "2015-01-01", len(REGISTERED)).collect()]
    return spark.createDataFrame([("all", d, n) for d, n in zip(sorted(days), REGISTERED, strict=True)], "series string, date date, ev_registrations long")


def test_running_fleet(spark):
    ahead = spark.createDataFrame([], "date date, ev_registrations long")
    rows = sorted(fc.projection(monthly(spark), ahead).collect(), key=lambda r: r["date"])
    assert [r["cumulative_ev_fleet"] for r in rows] == np.cumsum(REGISTERED).tolist() and rows[-1]["cumulative_ev_fleet"] == SO_FAR
    assert {r["type"] for r in rows} == {"actual"} and len(rows) == 108


def test_projection_is_near_the_published_one(spark):
    """The published model's order isn't known; each year's total lies within 13 % of its, and the fleet within 8.5 %."""
    own = monthly(spark)
    assert not needs_seasonal_difference(np.log(REGISTERED), 12)
    ahead = fc.forecast(own, "series", "date", "ev_registrations", 48)
    ahead = ahead.select("date", F.floor("mean").alias("ev_registrations"))
    rows = sorted(fc.projection(own, ahead).collect(), key=lambda r: r["date"])
    assert len(rows) == 156 and str(rows[-1]["date"]) == "2027-12-01"
    totals = [sum(r["ev_registrations"] for r in rows if r["date"].year == y) for y in range(2024, 2028)]
    assert totals == [pytest.approx(y, rel=0.13) for y in YEARS]
    assert rows[-1]["cumulative_ev_fleet"] == pytest.approx(FLEET, rel=0.085)


def test_seasonal_unit_root():
    """Found in seasonal random walks, not in fixed seasons around a trend."""
    rng = np.random.default_rng(0)

    def series(walk):
        x = rng.normal(size=264)
        if walk:
            for k in range(12, 264):
                x[k] += x[k - 12]
        return x[24:] + (0 if walk else np.resize(3 * rng.normal(size=12), 240))

    assert sum(needs_seasonal_difference(series(True), 12) for _ in range(30)) >= 26
    assert sum(needs_seasonal_difference(series(False), 12) for _ in range(30)) <= 4
    assert not needs_seasonal_difference(np.ones(100), 12) and not needs_seasonal_difference(np.arange(20.0), 12)


def test_a_constant_is_kept_only_where_it_pays():
    rng = np.random.default_rng(4)
    noise = rng.normal(size=150)
    assert not auto_sarima(noise - noise.mean()).drift
    assert auto_sarima(noise + 50).drift


def attributes(kind, values):
    return {"type": kind, "attributes": {"values": values}}


def test_grid_statistics(spark, tmp_path):
    by_kind = [attributes(t, [{"value": v, "percentage": p, "datetime": "2024-12-01"}]) for t, v, p, *_ in CAPACITY]
    (tmp_path / "capacity.json").write_text(json.dumps({"included": by_kind}))
    got = {tuple(r) for r in readers.series_json(spark, str(tmp_path / "capacity.json")).collect()}
    assert got == {(t, v, p) for t, _, _, v, p in CAPACITY}
    values = [{"value": v, "percentage": 1, "datetime": f"{m}-01T00:00:00.000+01:00"} for m, v, _ in DEMAND]
    (tmp_path / "demand.json").write_text(json.dumps({"included": [attributes("Demand", values)]}))
    got = {tuple(r) for r in readers.series_json(spark, str(tmp_path / "demand.json"), by_month=True).collect()}
    assert got == {(m, w) for m, _, w in DEMAND}


def test_seasonal_multipliers(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(OCCUPANCY)], "month int, x double")
    got = df.select("month", F.bround(F.col("x") / YEAR, 4).alias("m")).collect()
    assert [r["m"] for r in sorted(got)] == MULTIPLIER


def test_rounding_by_the_exact_value(spark):
    import random

    rng = random.Random(1)
    values = [0.125, 0.375, 2.675, 1.005, 12.345, 26250.145, -0.125, -2.675, 0.0, 1e15 + 0.3, 5e15, 0.004999, 0.005, 0.001, 1e-300, 4503599627370496.5]
    values += [rng.randrange(10**7) / 1000 for _ in range(400)] + [rng.uniform(-1e6, 1e6) for _ in range(200)] + [2.0**k for k in range(-12, 54)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r["v"]: r["r"] for r in df.select("v", hundredths(F.col("v")).alias("r")).collect()}
    assert got.pop(None) is None
    assert got == {v: round(v, 2) for v in values}
