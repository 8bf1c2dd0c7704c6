"""Readers of the heterogeneous inputs, each with an explicit schema."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geo, text
from ..functions.rounding import hundredths
from ..schemas import POPULATION, PROVINCES, TOURISM
from . import geojson as split


def geojson(spark: SparkSession, path: str, geometry: str, properties: str | None = None, parts: bool = False) -> DataFrame:
    """A row for each feature: its properties as columns, then geometry_type and geometry (the coordinates).

    geometry: type of the coordinates, as array<double> for points or array<array<double>> for lines. properties: their
    fields; then a large file is read by many tasks. None infers them, by a task for each file. Coordinates are longitude and
    latitude, the default of the format. parts: the files of a folder are one collection together."""
    if properties is None:
        whole = spark.read.option("multiLine", True).json(path)
        features = whole.select(F.explode("features").alias("f"))
        return features.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("geometry"))
    return split.features(spark, path, geometry, properties, parts)


def _with(fields: str, more: str | None) -> str:
    return f"{more}, {fields}" if more else fields


def roads(spark: SparkSession, path: str, more: str | None = None, parts: bool = False) -> DataFrame:
    """more: further properties and their types."""
    df = geojson(spark, path, "array<array<double>>", _with("Carretera string, Tipo_de_via string, Longitud double, PK_inicio string, PK_fin string, TENT string", more), parts)
    return df.withColumns({"PK_inicio": text.number(F.col("PK_inicio")), "PK_fin": text.number(F.col("PK_fin"))})


def traffic_stations(spark: SparkSession, path: str, more: str | None = None, parts: bool = False) -> DataFrame:
    df = geojson(spark, path, "array<double>", _with("Carretera string, PK string, IMD_total string, IMD_ligeros string, IMD_pesados string", more), parts)
    return df.withColumns({c: text.number(F.col(c)) for c in ("PK", "IMD_total", "IMD_ligeros", "IMD_pesados")})


def service_areas(spark: SparkSession, path: str) -> DataFrame:
    return geojson(spark, path, "array<double>")


def trunk_corridors(spark: SparkSession, path: str) -> DataFrame:
    return geojson(spark, path, "array<array<double>>", "Carretera string")


def polygons(spark: SparkSession, path: str, code: str, parts: bool = False) -> DataFrame:
    """(code, rings): of polygons and multi-polygons alike."""
    f = split.features(spark, path, "string", f"`{code}` string", parts)
    rings, multi = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    coords = F.col("geometry")
    both = F.when(F.col("geometry_type") == "MultiPolygon", F.flatten(F.from_json(coords, multi))).otherwise(F.from_json(coords, rings))
    return f.select(code, both.alias("rings"))


def charging_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites of a DATEX II file, split by row tag: id, names, place, number of connectors, greatest power in kW. Sites without a place are left out."""
    value = "struct<values: struct<value: string>>"
    line = f"struct<_order: string, text: {value}>"
    connector = "struct<maxPowerAtSocket: string>"
    schema = (
        f"_id string, name {value}, locationReference struct<coordinatesForDisplay: struct<latitude: string, longitude: string>, _locationReferenceExtension: struct<facilityLocation: struct<address: struct<postcode: string, addressLine: array<{line}>>>>>, "
        f"energyInfrastructureStation array<struct<refillPoint: array<struct<connector: array<{connector}>>>>>"
    )
    df = spark.read.format("xml").option("rowTag", "energyInfrastructureSite").option("ignoreNamespace", True).schema(schema).load(path)
    place = F.col("locationReference._locationReferenceExtension.facilityLocation.address")
    lines = F.transform(F.coalesce(place["addressLine"], F.array()), lambda x: F.struct(x["_order"].alias("order"), x["text"]["values"]["value"].alias("value")))
    points = F.flatten(F.transform(F.coalesce(F.col("energyInfrastructureStation"), F.array()), lambda s: F.coalesce(s["refillPoint"], F.array())))
    plugs = F.flatten(F.transform(points, lambda p: F.coalesce(p["connector"], F.array())))
    power = F.array_max(F.transform(plugs, lambda c: text.number(c["maxPowerAtSocket"]) / 1000.0))
    out = df.select(
        F.coalesce("_id", F.lit("")).alias("site_id"), F.col("name.values.value").alias("name"),
        text.number(F.col("locationReference.coordinatesForDisplay.latitude")).alias("latitude"), text.number(F.col("locationReference.coordinatesForDisplay.longitude")).alias("longitude"),
        text.labelled(lines, "1", "Dirección:").alias("address"), text.labelled(lines, "2", "Municipio:").alias("municipality"), text.labelled(lines, "3", "Provincia:").alias("province"),
        place["postcode"].alias("postcode"), F.size(plugs).alias("n_connectors"), F.greatest(F.coalesce(power, F.lit(0.0)), F.lit(0.0)).alias("max_power_kw"),
    )
    return out.na.drop(subset=["latitude", "longitude"])


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    line = spark.read.option("encoding", encoding).option("wholetext", False).text(path).first()[0]
    return [c.strip('"') for c in line.lstrip("﻿").rstrip("\r").split(sep)]


def strings_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text under their place: c0, c1, ...; headers(df) has the names, which may repeat."""
    names = _header(spark, path, sep, encoding)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).option("encoding", encoding).csv(path)
    df.headers = names
    return df


def _grid(df: DataFrame, at: dict[str, int], network: str, province: Column | None = None) -> DataFrame:
    c = lambda k: F.col(f"c{at[k]}")
    return df.select(
        text.strip(c("name")).alias("substation_name"), (text.strip(c("province")) if province is None else province).alias("provincia"), text.strip(c("town")).alias("municipio"),
        text.spanish_float(c("x")).alias("utm_x"), text.spanish_float(c("y")).alias("utm_y"), text.spanish_float(c("mw")).alias("available_capacity_mw"),
        text.spanish_float(c("kv")).alias("voltage_kv"), F.lit(network).alias("distributor_network"),
    )


def grid_ide(spark: SparkSession, path: str) -> DataFrame:
    df = strings_csv(spark, path)
    h = df.headers
    return _grid(df, {"name": h.index("Subestación"), "province": h.index("Provincia"), "town": h.index("Municipio"), "x": h.index("Coordenada UTM X"), "y": h.index("Coordenada UTM Y"), "mw": h.index("Capacidad firme disponible (MW)"), "kv": h.index("Nivel de Tensión (kV)")}, "i-DE")


def grid_endesa(spark: SparkSession, *paths: str) -> DataFrame:
    """Files whose province is a code and which may name the town twice; the last one counts."""
    out = None
    for p in paths:
        df = strings_csv(spark, p)
        h = [x.strip() for x in df.headers]
        at = {"name": h.index("Nombre Subestación"), "province": h.index("Provincia"), "town": len(h) - 1 - h[::-1].index("Municipio"), "x": h.index("Coordenada UTM X"), "y": h.index("Coordenada UTM Y"), "mw": h.index("Capacidad disponible (MW)"), "kv": h.index("Nivel de Tensión (kV)")}
        one = _grid(df, at, "Endesa", text.province_name(F.col(f"c{at['province']}"), PROVINCES))
        out = one if out is None else out.unionByName(one)
    return out


def grid_viesgo(spark: SparkSession, path: str) -> DataFrame:
    df = strings_csv(spark, path, encoding="ISO-8859-1")
    h = df.headers
    named = [i for i, x in enumerate(h) if "Nombre" in x and "subestaci" in x.lower()] or [i for i, x in enumerate(h) if "Subestaci" in x]
    at = {"name": named[0], "province": h.index("Provincia"), "town": h.index("Municipio"), "x": h.index("Coordenada UTM X"), "y": h.index("Coordenada UTM Y"), "mw": h.index("Capacidad firme disponible (MW)"), "kv": next(i for i, x in enumerate(h) if "tensi" in x.lower())}
    return _grid(df, at, "Viesgo")


GRID = {"ide": grid_ide, "endesa": grid_endesa, "viesgo": grid_viesgo}


def grid_capacity(spark: SparkSession, paths: dict[str, list[str]], distributor: str = "all") -> DataFrame:
    """One distributor or all: grid nodes with latitude and longitude; nodes outside the country's box are left out."""
    if distributor != "all" and distributor not in GRID:
        raise ValueError(f"unknown distributor {distributor!r}; one of {sorted(GRID)} or 'all'")
    out = None
    for name in GRID if distributor == "all" else [distributor]:
        one = GRID[name](spark, *paths[name])
        out = one if out is None else out.unionByName(one)
    lat, lon = geo.from_utm(F.col("utm_x"), F.col("utm_y"))
    return out.withColumns({"latitude": lat, "longitude": lon}).na.drop(subset=["latitude", "longitude"])


def ev_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Registrations of battery and plug-in cars for each monthly file yyyy_MM.parquet; months without any count 0.

    Each file is judged by its own columns: without the category it counts 0, without the kind of procedure all of its rows are
    registrations. Files that can't be read are left out. The names and footers of the files, one a month, are read by the driver."""
    category, procedure = "CATEGORÍA_VEHÍCULO_ELÉCTRICO", "CLAVE_TRAMITE"
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    groups: dict[str, tuple] = {}
    months = []
    for (name,) in listed.orderBy("path").collect():
        try:
            fields = [f for f in spark.read.parquet(name).schema if f.name in (category, procedure)]
        except Exception as e:
            if any(x in str(e) for x in ("FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "is not a Parquet file", "CANNOT_READ_FILE_FOOTER")):
                continue
            raise
        months.append((re.sub(r"\.parquet$", "", unquote(name).rsplit("/", 1)[-1])[:7],))
        schema = StructType(fields)
        if category in schema.names:
            groups.setdefault(schema.json(), (schema, []))[1].append(name)
    counts = spark.createDataFrame(months, "year_month string").select("year_month", F.lit(False).alias("ev"))
    for schema, names in groups.values():
        ev = F.col(category).isin("BEV", "PHEV")
        if procedure in schema.names:
            ev = ev & (F.col(procedure) == "1")
        month = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}_\d{2})", 1)
        counts = counts.union(spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*names).select(month, ev))
    out = counts.groupBy("year_month").agg(F.count_if(F.col("ev")).alias("ev_registrations"))
    return out.withColumn("date", F.to_date(F.col("year_month"), "yyyy_MM")).orderBy("date")


def fixed_width(spark: SparkSession, path: str, layout: list[tuple[str, int]], encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines of fixed fields after a first line that is skipped in each file; empty lines are left out."""
    lines = spark.read.option("encoding", encoding).option("header", True).option("sep", "\x00").option("quote", "").schema("value string").csv(path)
    return lines.filter(F.col("value").isNotNull() & (F.length("value") > 0)).select(*text.fixed_fields(F.col("value"), layout))


def unzipped(spark: SparkSession, path: str) -> DataFrame:
    """(file, member, content): the first member of every archive."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                with zipfile.ZipFile(io.BytesIO(batch.column(1)[i].as_py())) as z:
                    name = z.namelist()[0]
                    yield pa.RecordBatch.from_pydict({"file": [batch.column(0)[i].as_py()], "member": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInArrow(run, "file string, member string, content binary")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_kb) of the files below path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.bround(F.col("length") / 1024, 1).alias("size_kb")).orderBy("path")


def tourism(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOURISM).option("header", True).csv(path)


def tourism_raw(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a BOM; Total is a number with grouping dots."""
    names = _header(spark, path, "\t", "UTF-8")
    df = strings_csv(spark, path, "\t")
    return df.select(*((text.grouped_float(F.col(f"c{i}")) if n == "Total" else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)))


def population(spark: SparkSession, path: str) -> DataFrame:
    return plain_csv(spark, path, POPULATION)


def plain_csv(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """Comma-separated with a header. schema: types of the columns in their order, dates among them (ISO); None reads all as text under their names."""
    reader = spark.read.option("header", True).options(**options)
    return (reader.schema(schema) if schema else reader).csv(path)


def gas_stations(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under the file's own names; latitude and longitude, where there are such columns, as numbers."""
    df = plain_csv(spark, path)
    return df.withColumns({c: text.number(F.col(f"`{c}`")) for c in df.columns if c.strip().lower() in ("latitude", "longitude", "latitud", "longitud")})


def series_json(spark: SparkSession, path: str, by_month: bool = False) -> DataFrame:
    """Flattened statistics of a grid operator's API: (technology, capacity_mw, percentage), or (month, demand_mwh), rounded to hundredths by their exact values."""
    value = "struct<value: double, percentage: double, datetime: string>"
    schema = f"included array<struct<type: string, attributes: struct<values: array<{value}>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("included").alias("i")).select(F.col("i.type").alias("type"), F.explode("i.attributes.values").alias("v"))
    if by_month:
        return rows.select(F.substring("v.datetime", 1, 7).alias("month"), hundredths(F.col("v.value")).alias("demand_mwh"))
    return rows.select(F.col("type").alias("technology"), hundredths(F.col("v.value")).alias("capacity_mw"), hundredths(F.col("v.percentage")).alias("percentage"))


def month_requests(spark: SparkSession, first: str, last: str, url: str) -> DataFrame:
    """(month, url) of every monthly file to be fetched; the fetching itself is not the engine's."""
    m = spark.sql("SELECT explode(sequence(to_date(:a), to_date(:b), interval 1 month)) AS month", args={"a": first, "b": last})
    return m.select("month", F.concat(F.lit(url), F.date_format("month", "yyyyMM"), F.lit(".zip")).alias("url"))
