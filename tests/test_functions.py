"""Expressions against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.functions import dates, domain, geo, text
from viaduct.schemas import PROVINCES


def values(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_numbers_of_both_dialects(spark):
    raw = ["1.234,56", "12,5", "1.234", " ", "x", None, "nan", "1d", "-3,5", "\t7,0 "]
    rows = [(v,) for v in raw]
    assert values(spark, rows, "v string", text.spanish_float(F.col("v"))) == [1234.56, 12.5, 1.234, None, None, None, None, None, -3.5, 7.0]
    assert values(spark, [("1.234,56",), ("1.5",), (None,)], "v string", text.grouped_float(F.col("v"))) == [1234.56, 15.0, None]


def test_road_prefix(spark):
    rows = [(v,) for v in ["AP-7", "A-7", "AC-12", "N-340", "M-40", "123", None]]
    assert values(spark, rows, "v string", text.road_prefix(F.col("v"))) == ["AP", "A", "A", "N", "M", None, None]
    assert values(spark, rows, "v string", text.is_interurban(F.col("v"))) == [True, True, False, True, False, False, False]


def test_slices_padding_and_lookup(spark):
    rows = [("01022023",), ("2023",), ("x",), (None,)]
    assert values(spark, rows, "v string", text.from_right(F.col("v"), 4, 4)) == ["2023", "2023", None, None]
    assert values(spark, rows, "v string", text.from_right(F.col("v"), 6, 2)) == ["02", None, None, None]
    assert values(spark, [("7",), ("123456",)], "v string", text.zero_padded(F.col("v"), 5)) == ["00007", "123456"]
    assert values(spark, [("2",), ("02",), ("2.0",), ("Madrid",), ("99",), (None,)], "v string", text.province_name(F.col("v"), PROVINCES)) == ["Albacete"] * 3 + ["Madrid", "99", None]


def test_layout_text():
    body = "1 FECHA texto CHAR(8)\n2 MARCA\nlarga CHAR(30) x\n3 TIPO CHAR(2)"
    assert text.layout_of(body, 3) == [("FECHA", 8), ("MARCA", 30), ("TIPO", 2)]
    with pytest.raises(ValueError):
        text.layout_of(body, 4)


def test_dates(spark):
    rows = [(2024, 13, 1), (2024, 2, 29), (2023, 2, 29)]
    assert [str(v) for v in values(spark, rows, "y int, m int, d int", dates.date_of(F.col("y"), F.col("m"), F.col("d")))] == ["None", "2024-02-29", "None"]
    assert str(values(spark, [("2023_04",)], "v string", dates.month_start(F.col("v")))[0]) == "2023-04-01"
    assert [r[0].isoformat() for r in dates.months(spark, "2024-01-01", 48).collect()][-1] == "2027-12-01"


def test_status_chargers_and_season(spark):
    rows = [(5.0,), (4.999,), (1.0,), (0.999,), (None,), (float("nan"),)]
    got = values(spark, rows, "v double", domain.grid_status(F.col("v")))
    assert got == ["Sufficient", "Moderate", "Moderate", "Congested", "Congested", "Congested"]
    assert values(spark, [(0.0,), (2000.0,), (1e6,)], "v double", domain.chargers_needed(F.col("v"))) == [2, 4, 8]
    rows = [("AP-7", 7), ("AP-7", 6), ("A-8", 8), ("N-1", 8)]
    assert values(spark, rows, "r string, m int", domain.seasonal_multiplier(F.col("r"), F.col("m"))) == [2.0, 1.0, 1.5, 1.0]
    assert values(spark, [(70000,)], "n int", domain.co2_saving_t(F.col("n"))) == [1_120_000]


def test_haversine_and_half_even(spark):
    rows = [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 180.0)]
    got = values(spark, rows, "a double, b double, c double, d double", geo.haversine_km(*(F.col(c) for c in "abcd")))
    assert got[0] == pytest.approx(111.19492664455873, abs=1e-9) and got[1] == pytest.approx(math.pi * 6371)
    assert values(spark, [(0.125,)], "v double", F.bround("v", 2)) == [0.12]


def test_projection_goes_there_and_back(spark):
    rows = [(36.0 + i * 0.79, -9.0 + j * 1.2) for i in range(10) for j in range(10)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    x, y = geo.to_utm(F.col("lat"), F.col("lon"))
    lat, lon = geo.from_utm(F.col("x"), F.col("y"))
    for r in df.select("lat", "lon", x.alias("x"), y.alias("y")).select("*", lat.alias("la"), lon.alias("lo")).collect():
        assert r["la"] == pytest.approx(r["lat"], abs=1e-8) and r["lo"] == pytest.approx(r["lon"], abs=1e-8)
    on_axis = spark.createDataFrame([(40.0, -3.0)], "lat double, lon double").select(x.alias("x"), y.alias("y")).first()
    assert on_axis["x"] == pytest.approx(500000.0) and on_axis["y"] == pytest.approx(4427757.2, abs=1.0)
    far = spark.createDataFrame([(500000.0, 1000000.0)], "x double, y double").select(lat.alias("a"), lon.alias("b")).first()
    assert far["a"] is None and far["b"] is None


def exact_utm(lat, lon):
    """Gauss and Krüger's projection by its definition: the meridian's length continued along complex isometric latitudes."""
    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(f * (2 - f))

    def isometric(p):
        return np.arctanh(np.sin(p)) - e * np.arctanh(e * np.sin(p))

    want = isometric(complex(math.radians(lat))) + 1j * math.radians(lon + 3)
    phi = complex(math.radians(lat), 0.1)
    for _ in range(60):
        slope = (1 - e * e) / (np.cos(phi) * (1 - (e * np.sin(phi)) ** 2))
        phi -= (isometric(phi) - want) / slope
    nodes, weights = np.polynomial.legendre.leggauss(60)
    on = phi * (nodes + 1) / 2
    arc = a * (1 - e * e) * (weights * (1 - (e * np.sin(on)) ** 2) ** -1.5).sum() * phi / 2
    return 500000.0 + 0.9996 * arc.imag, 0.9996 * arc.real


def test_projection_off_the_axis_by_its_definition(spark):
    rows = [(36.0, -9.0), (40.416775, -3.70379), (43.7, 3.3), (39.5, 4.2), (36.1, 0.1)]
    x, y = geo.to_utm(F.col("lat"), F.col("lon"))
    for (lat, lon), r in zip(rows, spark.createDataFrame(rows, "lat double, lon double").select(x.alias("x"), y.alias("y")).collect(), strict=True):
        assert (r["x"], r["y"]) == pytest.approx(exact_utm(lat, lon), abs=1e-3)
