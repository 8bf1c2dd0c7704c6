"""Readers and writers on small files written here."""

import datetime
import io
import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from viaduct.sources import readers, sinks


def test_road_and_station_geojson(spark, tmp_path):
    f = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[-3.0, 40.0], [-3.1, 40.2]]}, "properties": {"Carretera": "A-1", "Tipo_de_via": "x", "Longitud": 1500.0, "PK_inicio": "1.5", "PK_fin": "bad", "TENT": None}}]}
    (tmp_path / "r.geojson").write_text(json.dumps(f))
    r = readers.roads(spark, str(tmp_path / "r.geojson")).first()
    assert (r["Carretera"], r["PK_inicio"], r["PK_fin"], r["geometry"]) == ("A-1", 1.5, None, [[-3.0, 40.0], [-3.1, 40.2]])
    f["features"][0] |= {"geometry": {"type": "Point", "coordinates": [-3.0, 40.0]}, "properties": {"Carretera": "A-1", "PK": "7", "IMD_total": "100"}}
    (tmp_path / "s.geojson").write_text(json.dumps(f))
    s = readers.traffic_stations(spark, str(tmp_path / "s.geojson")).first()
    assert (s["PK"], s["IMD_total"], s["IMD_pesados"], s["geometry"]) == (7.0, 100.0, None, [-3.0, 40.0])


def test_polygons_and_multi_polygons(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    f = {"features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"cod_prov": "01"}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}, "properties": {"cod_prov": "02"}}]}
    (tmp_path / "p.geojson").write_text(json.dumps(f))
    assert {r["cod_prov"]: len(r["rings"]) for r in readers.polygons(spark, str(tmp_path / "p.geojson"), "cod_prov").collect()} == {"01": 1, "02": 3}


SITE = """<d:payload xmlns:d="urn:d" xmlns:e="urn:e" xmlns:c="urn:c" xmlns:l="urn:l">
<e:energyInfrastructureSite id="S1"><e:name><c:values><c:value>Uno</c:value></c:values></e:name>
<l:locationReference><l:coordinatesForDisplay><l:latitude>40.5</l:latitude><l:longitude>-3.5</l:longitude></l:coordinatesForDisplay>
<l:_locationReferenceExtension><l:facilityLocation><l:address><l:postcode>28001</l:postcode>
<l:addressLine order="1"><l:text><c:values><c:value>Dirección: Calle 1</c:value></c:values></l:text></l:addressLine>
<l:addressLine order="2"><l:text><c:values><c:value>Municipio: Viejo</c:value></c:values></l:text></l:addressLine>
<l:addressLine order="2"><l:text><c:values><c:value>Municipio: Nuevo</c:value></c:values></l:text></l:addressLine>
<l:addressLine order="2"><l:text><c:values><c:value>Provincia: falsa</c:value></c:values></l:text></l:addressLine>
</l:address></l:facilityLocation></l:_locationReferenceExtension></l:locationReference>
<e:energyInfrastructureStation><e:refillPoint><e:connector><e:maxPowerAtSocket>50000</e:maxPowerAtSocket></e:connector><e:connector><e:maxPowerAtSocket>x</e:maxPowerAtSocket></e:connector></e:refillPoint></e:energyInfrastructureStation>
</e:energyInfrastructureSite>
<e:energyInfrastructureSite id="S2"><e:name><c:values><c:value>Sin sitio</c:value></c:values></e:name></e:energyInfrastructureSite>
</d:payload>"""


def test_charging_sites(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SITE, encoding="utf-8")
    rows = readers.charging_sites(spark, str(tmp_path / "s.xml")).collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert (r["site_id"], r["name"], r["address"], r["municipality"], r["province"]) == ("S1", "Uno", "Calle 1", "Nuevo", None)
    assert (r["latitude"], r["n_connectors"], r["max_power_kw"], r["postcode"]) == (40.5, 2, 50.0, "28001")


def test_grid_dialects(spark, tmp_path):
    (tmp_path / "ide.csv").write_text("Subestación;Provincia;Municipio;Coordenada UTM X;Coordenada UTM Y;Capacidad firme disponible (MW);Nivel de Tensión (kV)\n A ;Madrid;Villa;440.000,5;4.470.000,0;5,5;66\n;;;;;;\n", encoding="utf-8-sig")
    (tmp_path / "en.csv").write_text("Nombre Subestación;Provincia;Municipio;Municipio ;Coordenada UTM X;Coordenada UTM Y;Capacidad disponible (MW);Nivel de Tensión (kV)\nB;28;primero;segundo;440001;4470001;0,5;15\n", encoding="utf-8-sig")
    (tmp_path / "vi.csv").write_text("Nombre subestación;Nivel de tensión (kV);Provincia;Municipio;Coordenada UTM X;Coordenada UTM Y;Capacidad firme disponible (MW)\nPeña;12;Cantabria;Cué;400000;4790000;2\n", encoding="latin-1")
    paths = {"ide": [str(tmp_path / "ide.csv")], "endesa": [str(tmp_path / "en.csv")], "viesgo": [str(tmp_path / "vi.csv")]}
    rows = {r["substation_name"]: r for r in readers.grid_capacity(spark, paths).collect()}
    assert set(rows) == {"A", "B", "Peña"}
    assert rows["A"]["utm_x"] == 440000.5 and rows["A"]["available_capacity_mw"] == 5.5 and rows["A"]["distributor_network"] == "i-DE"
    assert rows["B"]["provincia"] == "Madrid" and rows["B"]["municipio"] == "segundo"
    assert rows["Peña"]["voltage_kv"] == 12.0 and 43 < rows["Peña"]["latitude"] < 44
    assert readers.grid_capacity(spark, paths, "endesa").count() == 1
    with pytest.raises(ValueError):
        readers.grid_capacity(spark, paths, "nobody")


def test_monthly_counts_keep_empty_months(spark, tmp_path):
    cols = "FEC_MATRICULA string, `CATEGORÍA_VEHÍCULO_ELÉCTRICO` string, CLAVE_TRAMITE string"
    for name, rows in (("2023_01", [("1", "BEV", "1"), ("1", "PHEV", "1"), ("1", "BEV", "2"), ("1", None, "1")]), ("2023_02", [("1", "HEV", "1")])):
        spark.createDataFrame(rows, cols).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    got = [tuple(r) for r in readers.ev_monthly(spark, str(tmp_path)).collect()]
    assert got == [("2023_01", 2, datetime.date(2023, 1, 1)), ("2023_02", 0, datetime.date(2023, 2, 1))]
    cat, kind = "CATEGORÍA_VEHÍCULO_ELÉCTRICO", "CLAVE_TRAMITE"
    at = tmp_path / "mixed"  # each file has columns of its own
    at.mkdir()
    pq.write_table(pa.table({"x": [1, 2, 3]}), at / "2024_01.parquet")
    pq.write_table(pa.table({cat: ["BEV", "PHEV", "HEV"]}), at / "2024_02.parquet")
    pq.write_table(pa.table({cat: ["BEV", "PHEV", None], kind: ["1", "2", "1"]}), at / "2024_03.parquet")
    pq.write_table(pa.table({cat: ["BEV"], kind: pa.array([None], pa.string())}), at / "2024_04.parquet")
    pq.write_table(pa.table({cat: pa.array([], pa.string())}), at / "2024_05.parquet")
    (at / "2024_06.parquet").write_bytes(b"not parquet")
    got = [(r["year_month"], r["ev_registrations"]) for r in readers.ev_monthly(spark, str(at)).collect()]
    assert got == [("2024_01", 0), ("2024_02", 2), ("2024_03", 1), ("2024_04", 0), ("2024_05", 0)]
    (tmp_path / "none").mkdir()
    assert readers.ev_monthly(spark, str(tmp_path / "none")).count() == 0


def test_fixed_width_and_zip(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("cabecera\r\n01022023SEAT  Ñ \r\n\r\n".encode("latin-1"))
    r = readers.fixed_width(spark, str(tmp_path / "a.txt"), [("fecha", 8), ("marca", 6), ("c", 2)]).collect()
    assert [tuple(x) for x in r] == [("01022023", "SEAT", "Ñ")]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("first.txt", "one")
        z.writestr("second.txt", "two")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.zip").write_bytes(buf.getvalue())
    u = readers.unzipped(spark, str(tmp_path / "z")).first()
    assert (u["member"], bytes(u["content"])) == ("first.txt", b"one")
    inv = readers.inventory(spark, str(tmp_path / "z")).first()
    assert inv["path"].endswith("a.zip") and inv["size_kb"] == round(len(buf.getvalue()) / 1024, 1)


def test_series_json_and_tables(spark, tmp_path):
    j = {"included": [{"type": "Solar", "attributes": {"values": [{"value": 12.345, "percentage": 0.125, "datetime": "2024-01-01T00:00:00.000+01:00"}]}}]}
    (tmp_path / "s.json").write_text(json.dumps(j))
    assert tuple(readers.series_json(spark, str(tmp_path / "s.json")).first()) == ("Solar", 12.35, 0.12)  # 12.345 is stored above the tie
    assert tuple(readers.series_json(spark, str(tmp_path / "s.json"), True).first()) == ("2024-01", 12.35)
    (tmp_path / "t.csv").write_text('province_code,province_name,month_name,month_number,occupancy_rate_pct,annual_occupancy_rate_pct,seasonal_multiplier\n02,"Coruña, A",Enero,1,20.64,36.45,0.5663\n')
    t = readers.tourism(spark, str(tmp_path / "t.csv")).first()
    assert t["province_code"] == "02" and t["province_name"] == "Coruña, A"
    assert round(t["occupancy_rate_pct"] / t["annual_occupancy_rate_pct"], 4) == t["seasonal_multiplier"]
    (tmp_path / "t.tsv").write_text("Lugar\tTotal\nx\t1.234,5\n", encoding="utf-8-sig")
    assert tuple(readers.tourism_raw(spark, str(tmp_path / "t.tsv")).first()) == ("x", 1234.5)
    m = readers.month_requests(spark, "2015-01-01", "2023-12-01", "http://x/")
    assert m.count() == 108


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, [3.0, 4.0])], "i int, s string, g array<double>")
    sinks.geojson_collection(df, str(tmp_path / "f"), "Point", "g", "i")
    c = json.loads("".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*"))))
    assert c["features"][1]["properties"] == {"i": 2, "s": None} and c["features"][0]["geometry"]["coordinates"] == [1.0, 2.0]
    sinks.geojson_lines(df, str(tmp_path / "g"), "Point", "g")
    assert spark.read.json(str(tmp_path / "g")).count() == 2
    sinks.csv(df.select("i", F.lit("ñ").alias("n")), str(tmp_path / "c"), "ISO-8859-1", single=True)
    assert b"\xf1" in next((tmp_path / "c").glob("part-*")).read_bytes()
    with pytest.raises(ValueError):
        sinks.csv(df.select("i"), str(tmp_path / "d"), single=True, most=1)
    sinks.json_records(df.select("i", "s"), str(tmp_path / "j"), by="i")
    assert (tmp_path / "j" / "part=1").exists() and spark.read.json(str(tmp_path / "j" / "part=2")).first()["i"] == 2
    sinks.monthly_parquet(df.select("i", "s", F.lit(2023).alias("y"), F.lit(4).alias("m")), str(tmp_path / "p"), "y", "m")
    assert (tmp_path / "p" / "y=2023" / "m=4").exists()
    layer = sinks.map_layer(spark.createDataFrame([("L", 40.0, -3.0, "Moderate")], "id string, latitude double, longitude double, grid_status string"))
    assert layer.first()["color"] == "orange" and "canvas" in sinks.map_html(layer)
