"""The pipelines end to end on small made-up inputs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from viaduct.functions import geo
from viaduct.operators.store import written
from viaduct.pipelines import fleet, network, open_data
from viaduct.schemas import FILE_1, FILE_2, FILE_3, REGISTRATION


@pytest.fixture(scope="module")
def segments(spark):
    """One road of 400 km along a parallel in eight segments, a trunk road of 50 km, and a street that isn't interurban."""
    rows = [("A-4", 50_000.0, i * 50.0, i * 50.0 + 50.0, "", [[-6.0 + i * 0.6, 40.0], [-6.0 + i * 0.6 + 0.6, 40.0]]) for i in range(8)]
    rows += [("AP-7", 50_000.0, 0.0, 50.0, "Core", [[-1.0, 38.0], [-0.4, 38.0]]), ("M-40", 10_000.0, 0.0, 10.0, None, [[-3.7, 40.4], [-3.6, 40.4]])]
    roads = spark.createDataFrame(rows, "Carretera string, Longitud double, PK_inicio double, PK_fin double, TENT string, geometry array<array<double>>")
    st = spark.createDataFrame([("A-4 ", 10.0, 20_000.0, 1.0, 1.0), ("A-4", 50.0, 10_000.0, None, 1.0), ("AP-7", 5.0, 90_000.0, 1.0, 1.0)], "Carretera string, PK double, IMD_total double, IMD_ligeros double, IMD_pesados double")
    box = lambda a, b: [[[a, 35.0], [b, 35.0], [b, 45.0], [a, 45.0], [a, 35.0]]]
    prov = spark.createDataFrame([("01", box(-7.0, -3.0)), ("02", box(-3.0, 1.0))], "cod_prov string, rings array<array<array<double>>>")
    return written(network.road_segments(roads, st, provinces=prov), "segments")


@pytest.fixture(scope="module")
def sites(spark):
    cols = "site_id string, name string, latitude double, longitude double"
    return spark.createDataFrame([("near", "n", 40.001, -5.7), ("near", "again", 40.001, -5.6), ("far", "f", 42.0, -5.7), ("abroad", "x", 50.0, 3.0), ("coast", "c", 38.001, -0.7)], cols)


def test_segments(segments):
    rows = {r["segment_id"]: r for r in segments.collect()}
    assert len(rows) == 9 and [rows[i]["segment_id"] for i in range(9)] == list(range(9))
    a4 = sorted((r for r in rows.values() if r["Carretera"] == "A-4"), key=lambda r: r["PK_inicio"])
    assert a4[0]["imd_total"] == 15_000.0 and a4[0]["n_stations"] == 2  # a station at kilometre 50 counts for both sides
    assert a4[1]["imd_total"] == 10_000.0 and a4[5]["imd_total"] == 12_500.0  # the median of the road's filled segments
    assert {r["cod_prov"] for r in a4[:4]} == {"01"} and a4[7]["cod_prov"] == "02"
    trunk = next(r for r in rows.values() if r["Carretera"] == "AP-7")
    assert trunk["is_tent"] and trunk["max_spacing_km"] == 60 and trunk["road_prefix"] == "AP" and not a4[0]["is_tent"]


def test_baseline_and_gaps(segments, sites):
    ch = written(network.interurban_chargers(sites, segments), "chargers")
    got = {r["site_id"]: r for r in ch.collect()}
    assert set(got) == {"near", "coast"} and got["near"]["nearest_road"] == "A-4" and 0 < got["near"]["dist_to_road_m"] < 200
    cov = {(r["Carretera"], r["PK_inicio"]): r for r in network.segment_coverage(segments, ch).collect()}
    assert not cov["A-4", 0.0]["is_gap"] and cov["A-4", 350.0]["is_gap"] and not cov["AP-7", 0.0]["is_gap"]
    none = network.segment_coverage(segments, ch.filter("false"))
    assert none.filter("is_gap").count() == 9 and none.filter("dist_to_charger_km is null").count() == 9


def test_proposals_to_files(spark, segments, sites):
    ch = written(network.interurban_chargers(sites, segments), "chargers")
    want = network.demand(segments, 2_498_159, 7)
    rows = {r["route_segment"]: r for r in want.collect()}
    assert rows["AP-7"]["seasonal_multiplier"] == 2.0 and rows["AP-7"]["is_coastal"] and max(r["n_chargers_needed"] for r in want.collect() if r["route_segment"] == "A-4") == 3
    prop = written(network.proposals(segments, ch, want), "proposed")
    got = prop.collect()
    assert len(got) == 2 and all(r["latitude"] == pytest.approx(40.0) and -6 <= r["longitude"] <= -1.2 for r in got)
    x, y = geo.to_utm(F.col("latitude"), F.col("longitude"))
    assert {r["n_chargers_proposed"] for r in got} == {2}
    nodes = spark.createDataFrame([("S", "p", "m", 5.5, 66.0, "Endesa", 40.05, got[0]["longitude"]), ("S", None, "m", 0.5, 132.0, "Endesa", 40.05, got[0]["longitude"])], "substation_name string, provincia string, municipio string, available_capacity_mw double, voltage_kv double, distributor_network string, latitude double, longitude double")
    grid = written(network.substations(nodes.withColumns({"utm_x": x, "utm_y": y})), "grid")
    g = grid.first()
    assert grid.count() == 1 and g["provincia"] == "p" and g["voltage_kv"] == 132.0 and g["grid_status"] == "Sufficient"
    via = network.viability(prop, grid)
    f1, f2, f3 = network.deliverables(via, ch, 2_498_159)
    assert (f1.columns, f2.columns, f3.columns) == (FILE_1, FILE_2, FILE_3)
    assert tuple(f1.first()) == (2, 2, 1, 2_498_159)
    assert sorted(r["grid_status"] for r in f2.collect()) == ["Congested", "Sufficient"]
    r = f3.first()
    assert r["estimated_demand_kw"] == 300 and r["distributor_network"] == "i-DE"


def test_registrations(spark):
    rng = random.Random(0)
    rows = [(f"01{m:02d}{y}", rng.choice(["SEAT", "TESLA"]), rng.choice(["X", "Y"]), "40", p, None, "1") for y in (2022, 2023) for m in range(1, 13) for p in ("0", "1", "2", "2", "9")]
    rows += [("01012014", "OLD", "X", "40", "2", None, "1"), ("01012023", "VAN", "X", "25", "2", None, "1"), ("01012023", "NOTFIRM", "X", "40", "2", None, "7"), ("01012023", "ODD", "X", "40", "Z", None, "1"), (None, "NODATE", "X", "40", "2", None, "1")]
    clean = fleet.clean_registrations(spark.createDataFrame(rows, REGISTRATION)).cache()
    assert clean.count() == 120 and not {"OLD", "VAN", "NOTFIRM", "ODD", "NODATE"} & {r["MARCA_ITV"] for r in clean.collect()}
    assert fleet.top_brands(clean, 2023, 1).count() == 1 and fleet.top_brands(clean, 2023, 10, ("MARCA_ITV", "MODELO_ITV"), "Eléctrico").agg(F.sum("matriculaciones")).first()[0] == 24
    share = {r["propulsion"]: r["pct"] for r in fleet.market_share(clean, 2023).collect()}
    assert share == {"Gasolina": 20.0, "Diesel": 20.0, "Eléctrico": 40.0, "Otros": 20.0}
    m = fleet.monthly_by_kind(clean).filter("ano = 2023 and mes = 5").first()
    assert m["TOTAL"] == 5 and m["Eléctrico_pct"] == 40.0
    assert {tuple(r)[1:] for r in fleet.heat_map(clean, [2022, 2023], True).collect()} == {(2.0, 2.0)} and {tuple(r)[1:] for r in fleet.heat_map(clean, [2022, 2023], False).collect()} == {(3.0, 3.0)}
    s = fleet.electric_series(clean).orderBy("date").collect()
    assert len(s) == 24 and s[0]["date"] == datetime.date(2022, 1, 1)
    p = fleet.project(spark.createDataFrame([(r["date"], r["ev_registrations"] + 10 + i) for i, r in enumerate(s)], "date date, ev_registrations long"), 6)
    assert p.count() == 30 and p.filter("type = 'forecast'").agg(F.min("date")).first()[0] == datetime.date(2024, 1, 1)
    assert tuple(fleet.co2(spark.createDataFrame([(10.4,), (20.2,)], "mean double")).first()) == (31, 496)


def test_accidents(spark):
    a = spark.createDataFrame([(2024, 1, d, h, 2, float(d % 2), 1.0, None if h else 3.0, c) for d in range(1, 8) for h in range(24) for c in ("46001", "46002") if (d, h, c) != (1, 0, "46001")], "ANYO int, MES int, DIA_SEMANA int, HORA int, TOTAL_VICTIMAS_24H int, TIPO_ACCIDENTE double, TITULARIDAD_VIA double, TIPO_VIA double, COD_MUNICIPIO string")
    w = open_data.by_weekday_hour(a).orderBy("index").collect()
    assert len(w) == 167 and [r["index"] for r in w] == list(range(167))  # the slot with one accident is gone
    assert w[-1]["VICTIMAS_acc"] == 167 * 4 and w[0]["date"] == datetime.datetime(2024, 1, 1, 1)
    assert open_data.envelope(open_data.by_weekday_hour(a)).count() == 24
    c = open_data.category_counts(a, "TIPO_VIA").collect()
    assert [tuple(r) for r in c] == [(0, 3.0, 13)]
    places = spark.createDataFrame([("46001",), ("46003",), ("47001",)], "MUNIINE string")
    assert {tuple(r) for r in open_data.by_municipality(a, places).collect()} == {("46001", 167), ("46003", 0)}


def test_ratios_and_means(spark):
    pos = spark.createDataFrame([("turismos", 3), ("camiones", 4)], "`Tipo vehículo` string, `Resultado positivo` long")
    park = spark.createDataFrame([("Turismos", 10.0), ("Camiones", 3.0), ("Camiones", 5.0)], "`Tipo de Vehículo` string, Total double")
    got = {r[0]: (r["Parque"], r["Ratio"]) for r in open_data.positives_by_fleet(pos, park, "Tipo vehículo", "Tipo de Vehículo").collect()}
    assert got == {"turismos": (10.0, 0.3), "camiones": (8.0, 0.5)}
    lv = spark.createDataFrame([("b", "r", 1.0), ("b", "r", 2.005)], "cuenca string, embalse string, v double")
    assert open_data.ten_year_means(lv, "cuenca", "embalse", "v", "media").first()["media"] == 1.5
    m = spark.createDataFrame([(20.64, 36.45), (1.0, 0.0)], "occupancy_rate_pct double, annual_occupancy_rate_pct double")
    assert [r["seasonal_multiplier"] for r in open_data.seasonal_multipliers(m).collect()] == [0.5663, None]
