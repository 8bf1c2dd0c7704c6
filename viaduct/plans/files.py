"""Sources and sinks: tables are rendered as files in the shared folder, in the formats of the inputs, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import shared_dir
from ..functions import text
from ..sources import archives, geojson, readers, sinks
from .registry import query, t
from .spatial import _INV


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _spanish(hundredths: Column) -> Column:
    """Whole hundredths as text with grouping dots and a decimal comma."""
    return F.translate(F.format_number(hundredths / 100, 2), ",.", ".,")


def _nodes(spark: SparkSession, d: str, share: int) -> DataFrame:
    """A third of the suppliers as grid nodes, numbers in the dialect of the files."""
    k = F.col("s_suppkey")
    s = t(spark, d, "supplier").filter(k % 3 == share)
    return s.select(
        F.concat(F.lit(" "), "s_name", F.lit("  ")).alias("name"), "s_nationkey", F.concat(F.lit("Peñíscola "), k.cast("string")).alias("town"),
        _spanish(50000000 + k).alias("x"), _spanish(440000000 + k).alias("y"), F.when(k % 4 != 0, _spanish(k * 37 % 1000)).alias("mw"), F.lit("132,0").alias("kv"),
    )


def _semicolons(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    df.write.option("header", True).option("sep", ";").option("encoding", encoding).csv(path)
    return path


@query(f"""WITH s AS (SELECT *, s_suppkey % 3 AS share FROM supplier), u AS (SELECT s_suppkey AS point_id, (50000000 + s_suppkey) / 100.0::DOUBLE AS utm_x, (440000000 + s_suppkey) / 100.0::DOUBLE AS utm_y FROM s), {_INV}
SELECT round(la, 7) AS latitude, round(lo, 7) AS longitude, s_name AS substation_name, 'Peñíscola ' || CAST(s_suppkey AS VARCHAR) AS municipio, CASE share WHEN 0 THEN 'Castellón' WHEN 1 THEN 'Madrid' ELSE 'Cantabria' END AS provincia,
(50000000 + s_suppkey) / 100.0::DOUBLE AS utm_x, (440000000 + s_suppkey) / 100.0::DOUBLE AS utm_y, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey * 37 % 1000) / 100.0::DOUBLE END AS available_capacity_mw,
132.0::DOUBLE AS voltage_kv, CASE share WHEN 0 THEN 'i-DE' WHEN 1 THEN 'Endesa' ELSE 'Viesgo' END AS distributor_network FROM s JOIN b ON point_id = s_suppkey""")
def grid_files(spark: SparkSession, d: str) -> DataFrame:
    """The three distributors' files: UTF-8 and Latin-1, a repeated column, provinces by name and by code."""
    x, y, kv = F.col("x").alias("Coordenada UTM X"), F.col("y").alias("Coordenada UTM Y"), F.col("kv").alias("Nivel de Tensión (kV)")
    firm = F.col("mw").alias("Capacidad firme disponible (MW)")
    ide = _nodes(spark, d, 0).select(F.col("name").alias("Subestación"), F.lit("Castellón").alias("Provincia"), F.col("town").alias("Municipio"), x, y, firm, kv)
    endesa = _nodes(spark, d, 1).select(F.col("name").alias("Nombre Subestación"), F.lit("28").alias("Provincia"), F.lit("another").alias("Municipio "), x, y, F.col("mw").alias("Capacidad disponible (MW)"), kv, F.col("town").alias("Municipio"))
    viesgo = _nodes(spark, d, 2).select(F.col("name").alias("Nombre de la subestación"), F.lit("Cantabria").alias("Provincia"), F.col("town").alias("Municipio"), x, y, firm, kv)
    paths = {"ide": [_semicolons(ide, _place(spark, "ide"))], "endesa": [_semicolons(endesa, _place(spark, "endesa"))], "viesgo": [_semicolons(viesgo, _place(spark, "viesgo"), "ISO-8859-1")]}
    return readers.grid_capacity(spark, paths).withColumns({c: F.round(c, 7) for c in ("latitude", "longitude")})


@query("SELECT o_orderkey, o_custkey, o_totalprice, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month FROM orders WHERE year(o_orderdate) = 1995")
def monthly_files(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each month, written and read by its partitions; one year is pruned by them."""
    path = _place(spark, "monthly")
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    sinks.monthly_parquet(o, path, "year", "month")
    return spark.read.schema(o.schema).parquet(path).filter("year = 1995")


@query("SELECT c_custkey, c_name, c_nationkey, 'Añó ' || c_mktsegment AS label FROM customer")
def latin_csv(spark: SparkSession, d: str) -> DataFrame:
    """Latin-1 CSV with a header, written and read."""
    path = _place(spark, "latin")
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.concat(F.lit("Añó "), "c_mktsegment").alias("label"))
    sinks.csv(c, path, encoding="ISO-8859-1")
    return spark.read.schema(c.schema).option("header", True).option("encoding", "ISO-8859-1").csv(path)


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def json_files(spark: SparkSession, d: str) -> DataFrame:
    """JSON records in a folder for each region, one of which is read."""
    path = _place(spark, "records")
    n = t(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    sinks.json_records(n, path, by="n_regionkey")
    return spark.read.schema(n.schema).json(f"{path}/part=2")


@query("""SELECT c_custkey, c_name || ' {"a": [}' AS label, 'Point' AS geometry_type, -3.0::DOUBLE - c_custkey % 1000 / 8.0::DOUBLE AS lon, 40.0::DOUBLE + c_custkey % 500 / 8.0::DOUBLE AS lat FROM customer""")
def geojson_points(spark: SparkSession, d: str) -> DataFrame:
    """All customers as one collection of points, written in parts and read by byte ranges; labels hold braces and quotes."""
    k, path = F.col("c_custkey"), _place(spark, "points")
    places = t(spark, d, "customer").select(k, F.concat("c_name", F.lit(' {"a": [}')).alias("label"), F.array(-3.0 - k % 1000 / 8, 40.0 + k % 500 / 8).alias("geometry"))
    sinks.geojson_collection(places, path, "Point", "geometry", "c_custkey")
    read = geojson.features(spark, path, "array<double>", "c_custkey bigint, label string", parts=True)
    return read.select("c_custkey", "label", "geometry_type", F.col("geometry")[0].alias("lon"), F.col("geometry")[1].alias("lat"))


@query("""SELECT o_orderkey, o_orderstatus AS status, strftime(o_orderdate, '%d%m%Y') AS fecha, 'Añ' || substr(o_orderpriority, 1, 1) AS marca,
'orders_' || o_orderkey % 24 || '.zip' AS file, 'part' || o_orderkey % 3 || '.txt' AS member FROM orders""")
def zip_archives(spark: SparkSession, d: str) -> DataFrame:
    """Orders as fixed-width Latin-1 lines in three members of each of 24 archives, read member by member; first lines are heads."""
    k, path = F.col("o_orderkey"), _place(spark, "zips")
    line = F.concat(F.rpad(k.cast("string"), 12, " "), "o_orderstatus", F.date_format("o_orderdate", "ddMMyyyy"), F.lit("Añ"), F.substring("o_orderpriority", 1, 1))
    rows = t(spark, d, "orders").select(F.concat(F.lit("orders_"), k % 24, F.lit(".zip")).alias("file"), F.concat(F.lit("part"), k % 3, F.lit(".txt")).alias("member"), k.alias("number"), line.alias("value"))
    archives.write_zips(rows, path, "number", head="KEY ESTADO FECHA MARCA", encoding="ISO-8859-1")
    lines = archives.zipped_lines(spark, path, encoding="ISO-8859-1").filter("number > 0 and value <> ''")
    own = lines.select("file", "member", *text.fixed_fields(F.col("value"), [("o_orderkey", 12), ("status", 1), ("fecha", 8), ("marca", 3)]))
    return own.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


def _site(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier as a charging site in XML, a line for each: repeated address lines, powers that are no numbers, some without a place."""
    k = F.col("s_suppkey")
    place = lambda whole: F.format_string("%d.%05d", F.floor(whole / 100000), whole % 100000)
    value = lambda c: F.concat(F.lit("<c:values><c:value>"), c, F.lit("</c:value></c:values>"))
    line = lambda order, c: F.concat(F.lit(f'<l:addressLine order="{order}"><l:text>'), value(c), F.lit("</l:text></l:addressLine>"))
    plug = lambda c: F.concat(F.lit("<e:connector><e:maxPowerAtSocket>"), c, F.lit("</e:maxPowerAtSocket></e:connector>"))
    text_of = lambda start, c: F.concat(F.lit(start), c.cast("string"))
    coordinates = F.concat(F.lit("<l:coordinatesForDisplay><l:latitude>"), place(3600000 + k * 7919 % 700000), F.lit("</l:latitude><l:longitude>"), place(100000 + k * 104729 % 300000), F.lit("</l:longitude></l:coordinatesForDisplay>"))
    address = F.concat(
        F.lit("<l:_locationReferenceExtension><l:facilityLocation><l:address><l:postcode>"), F.lpad((k % 53000).cast("string"), 5, "0"), F.lit("</l:postcode>"),
        line(1, text_of("Dirección: Calle ", k)), line(2, F.lit("Municipio: Viejo")), line(2, text_of("Municipio: Villa ", k)), F.when(k % 5 != 0, line(3, text_of("Provincia: P", F.col("s_nationkey")))).otherwise(""),
        F.lit("</l:address></l:facilityLocation></l:_locationReferenceExtension>"),
    )
    plugs = F.concat(F.when(k % 11 != 0, F.concat(plug(F.lit("22000")), plug((k * 100 % 350000).cast("string")))).otherwise(""), plug(F.lit("n/a")))
    return t(spark, d, "supplier").select(k.alias("key"), F.concat(
        F.lit('<e:energyInfrastructureSite xmlns:e="urn:e" xmlns:c="urn:c" xmlns:l="urn:l" id="S'), k.cast("string"), F.lit('"><e:name>'), value(F.concat("s_name", F.lit(" &amp; Co"))), F.lit("</e:name><l:locationReference>"),
        F.when(k % 7 != 0, coordinates).otherwise(""), address, F.lit("</l:locationReference><e:energyInfrastructureStation><e:refillPoint>"), plugs, F.lit("</e:refillPoint></e:energyInfrastructureStation></e:energyInfrastructureSite>"),
    ).alias("value"))


@query("""SELECT 'S' || s_suppkey AS site_id, s_name || ' & Co' AS name, (3600000 + s_suppkey * 7919 % 700000) / 100000.0::DOUBLE AS latitude, (100000 + s_suppkey * 104729 % 300000) / 100000.0::DOUBLE AS longitude,
'Calle ' || s_suppkey AS address, 'Villa ' || s_suppkey AS municipality, CASE WHEN s_suppkey % 5 <> 0 THEN 'P' || s_nationkey END AS province, lpad(CAST(s_suppkey % 53000 AS VARCHAR), 5, '0') AS postcode,
CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 3 END AS n_connectors, CASE WHEN s_suppkey % 11 = 0 THEN 0.0::DOUBLE ELSE greatest(22000, s_suppkey * 100 % 350000) / 1000.0::DOUBLE END AS max_power_kw FROM supplier WHERE s_suppkey % 7 <> 0""")
def charging_sites(spark: SparkSession, d: str) -> DataFrame:
    """Charging sites written as XML and read by their row tag: the last matching address line counts, powers that can't be read count 0."""
    path = _place(spark, "sites")
    sites = _site(spark, d).select((F.col("key") % 16).alias("file"), F.lit(1).alias("at"), "value")
    roots = sites.select("file").distinct().select("file", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("<payload>").alias("value")), F.struct(F.lit(2).alias("at"), F.lit("</payload>").alias("value")))).alias("r"))
    whole = sites.unionByName(roots.select("file", "r.*")).repartition("file").sortWithinPartitions("file", "at")
    whole.select("file", "value").write.partitionBy("file").text(path)  # sorted as the writer wants it, so the root stays around its sites
    return readers.charging_sites(spark, path)


def _named(spark: SparkSession, folder: str, path: str) -> None:
    """Renames the one file in each `name=` folder to its name; the files are few, one for each month."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))
    for s in fs.globStatus(at(f"{folder}/name=*/part-*")):
        name = s.getPath().getParent().getName().split("=", 1)[1]
        if not fs.rename(s.getPath(), at(f"{path}/{name}")):
            raise OSError(f"{s.getPath().toString()} can't be renamed")


@query("""SELECT strftime(o_orderdate, '%Y_%m') AS year_month, count(*) FILTER (WHERE month(o_orderdate) % 4 <> 0 AND o_orderkey % 4 IN (1, 2) AND (month(o_orderdate) % 3 = 0 OR o_custkey % 3 = 1)) AS ev_registrations,
strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS date FROM orders GROUP BY 1, 3""")
def registration_months(spark: SparkSession, d: str) -> DataFrame:
    """A registration file for each month, some without the category, some without the procedure, and one that is no Parquet file."""
    path, month = _place(spark, "registrations"), F.month("o_orderdate")
    kind = F.get(F.array(F.lit(None), F.lit("BEV"), F.lit("PHEV"), F.lit("HEV")), (F.col("o_orderkey") % 4).cast("int"))
    o = t(spark, d, "orders").select("o_orderkey", month.alias("m"), kind.alias("CATEGORÍA_VEHÍCULO_ELÉCTRICO"), (F.col("o_custkey") % 3).cast("string").alias("CLAVE_TRAMITE"), F.concat(F.date_format("o_orderdate", "yyyy_MM"), F.lit(".parquet")).alias("name"))
    for k, (rows, gone) in enumerate(((F.col("m") % 4 == 0, "CATEGORÍA_VEHÍCULO_ELÉCTRICO"), ((F.col("m") % 4 != 0) & (F.col("m") % 3 == 0), "CLAVE_TRAMITE"), ((F.col("m") % 4 != 0) & (F.col("m") % 3 != 0), None))):
        own = o.filter(rows).drop("m", *([gone] if gone else []))
        own.repartition("name").write.partitionBy("name").parquet(f"{path}-{k}")
        _named(spark, f"{path}-{k}", path)
    broken = spark.createDataFrame([("no such format", "1980_01.parquet")], "value string, name string")
    broken.coalesce(1).write.partitionBy("name").text(f"{path}-broken")
    _named(spark, f"{path}-broken", path)
    return readers.ev_monthly(spark, path).withColumn("date", F.col("date").cast("string"))


@query("""SELECT p_partkey, 'A-' || p_partkey % 50 AS Carretera, 'Autovía' AS Tipo_de_via, p_partkey % 700 * 1.5::DOUBLE AS Longitud, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 300 / 4.0::DOUBLE END AS PK_inicio,
p_partkey % 300 + 5.0::DOUBLE AS PK_fin, CASE WHEN p_partkey % 4 = 0 THEN 'T' WHEN p_partkey % 4 = 1 THEN '' END AS TENT, 2 + p_partkey % 3 AS n_points, -3.0::DOUBLE - p_partkey % 100 / 8.0::DOUBLE AS first_lon, coalesce(p_partkey % 4 = 0, false) AS is_tent FROM part""")
def road_files(spark: SparkSession, d: str) -> DataFrame:
    """Roads as one collection of lines, written in parts and read again; kilometres as text, some of it no number."""
    k, path = F.col("p_partkey"), _place(spark, "roads")
    line = F.transform(F.sequence(F.lit(0), 1 + (k % 3).cast("int")), lambda i: F.array(-3.0 - k % 100 / 8, 40.0 + i / 8))
    pk = F.when(k % 9 != 0, (k % 300 / 4).cast("string")).otherwise("sin dato")
    props = t(spark, d, "part").select(
        k, F.concat(F.lit("A-"), k % 50).alias("Carretera"), F.lit("Autovía").alias("Tipo_de_via"), (k % 700 * 1.5).alias("Longitud"), pk.alias("PK_inicio"), (k % 300 + 5).cast("string").alias("PK_fin"),
        F.when(k % 4 == 0, "T").when(k % 4 == 1, "").alias("TENT"), line.alias("geometry"),
    )
    sinks.geojson_collection(props, path, "LineString", "geometry", "p_partkey")
    read = readers.roads(spark, path, "p_partkey bigint", parts=True)
    return read.select("p_partkey", "Carretera", "Tipo_de_via", "Longitud", "PK_inicio", "PK_fin", "TENT", F.size("geometry").cast("bigint").alias("n_points"), F.col("geometry")[0][0].alias("first_lon"), F.coalesce(F.col("TENT") != "", F.lit(False)).alias("is_tent"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS cod_prov, CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 1 END AS n_rings, CASE WHEN c_custkey % 3 = 0 THEN 12 ELSE 4 END AS n_points, c_custkey * 1.0::DOUBLE AS first_x FROM customer""")
def polygon_files(spark: SparkSession, d: str) -> DataFrame:
    """Polygons and multi-polygons in one collection each, by byte ranges; both come back as lists of rings."""
    k, base = F.col("c_custkey"), _place(spark, "polygons")
    ring = F.array(*(F.array(k + a, F.lit(b)) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))))
    code = k.cast("string").alias("cod_prov")
    own = t(spark, d, "customer")
    sinks.geojson_collection(own.filter(k % 3 != 0).select(code, F.array(ring).alias("geometry")), f"{base}/one", "Polygon", "geometry", "cod_prov")
    sinks.geojson_collection(own.filter(k % 3 == 0).select(code, F.array(F.array(ring), F.array(ring, ring)).alias("geometry")), f"{base}/many", "MultiPolygon", "geometry", "cod_prov")
    both = readers.polygons(spark, f"{base}/one", "cod_prov", parts=True).union(readers.polygons(spark, f"{base}/many", "cod_prov", parts=True))
    points = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r))
    return both.select("cod_prov", F.size("rings").alias("n_rings"), points.alias("n_points"), F.col("rings")[0][0][0].alias("first_x"))


@query("""SELECT s_suppkey AS id, 'A-' || s_suppkey % 50 AS Carretera, s_suppkey % 300 / 4.0::DOUBLE AS PK, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 10.0::DOUBLE END AS IMD_total, -3.0::DOUBLE - s_suppkey % 100 / 8.0::DOUBLE AS lon FROM supplier""")
def station_files(spark: SparkSession, d: str) -> DataFrame:
    """Traffic stations as one collection of points; counts as text, missing ones empty."""
    k, path = F.col("s_suppkey"), _place(spark, "stations")
    count = F.when(k % 5 != 0, (k * 10).cast("string")).otherwise("")
    rows = t(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("A-"), k % 50).alias("Carretera"), (k % 300 / 4).cast("string").alias("PK"), count.alias("IMD_total"), F.array(-3.0 - k % 100 / 8, F.lit(40.0)).alias("geometry"))
    sinks.geojson_collection(rows, path, "Point", "geometry", "id")
    read = readers.traffic_stations(spark, path, "id bigint", parts=True)
    return read.select("id", "Carretera", "PK", "IMD_total", F.col("geometry")[0].alias("lon"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice, CASE WHEN o_orderkey % 6 <> 0 THEN 'a "b", ' || o_orderkey END AS label FROM orders WHERE o_orderkey % 6 <> 1 AND year(o_orderdate) >= 1995""")
def dated_csv(spark: SparkSession, d: str) -> DataFrame:
    """CSV with dates and quoted text, written and read under a schema with a date; rows with an empty label are left out, missing labels stay."""
    path, k = _place(spark, "dated"), F.col("o_orderkey")
    label = F.when(k % 6 == 1, "").when(k % 6 != 0, F.concat(F.lit('a "b", '), k))
    o = t(spark, d, "orders").select(k, F.col("o_orderdate").cast("date").alias("date"), "o_totalprice", label.alias("label"))
    o.write.option("header", True).option("nullValue", "-").csv(path)
    read = readers.plain_csv(spark, path, "o_orderkey bigint, date date, o_totalprice double, label string", nullValue="-")
    kept = read.filter((F.col("date") >= F.to_date(F.lit("1995-01-01"))) & ~F.coalesce(F.col("label") == "", F.lit(False)))
    return kept.withColumn("date", F.col("date").cast("string"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ideess, s_name AS rotulo, s_suppkey % 100 / 8.0::DOUBLE AS latitude, CASE WHEN s_suppkey % 3 <> 0 THEN -(s_suppkey % 80) / 4.0::DOUBLE END AS longitude FROM supplier""")
def gas_station_csv(spark: SparkSession, d: str) -> DataFrame:
    """Fuel stations as CSV, all text but for the coordinates, one of which is sometimes no number."""
    path, k = _place(spark, "fuel"), F.col("s_suppkey")
    east = F.when(k % 3 != 0, (-(k % 80) / 4).cast("string")).otherwise("?")
    sinks.csv(t(spark, d, "supplier").select(k.alias("ideess"), F.col("s_name").alias("rotulo"), (k % 100 / 8).alias("latitude"), east.alias("longitude")), path)
    return readers.gas_stations(spark, path)


@query("""SELECT 'shelf=' || c_custkey % 20 AS folder, round_even((sum(length(c_name)) + count(*)) / 1024.0::DOUBLE, 1) AS size_kb FROM customer GROUP BY 1""")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Customers' names on twenty shelves, one file each, and what the files weigh."""
    path = _place(spark, "shelves")
    rows = t(spark, d, "customer").select((F.col("c_custkey") % 20).alias("shelf"), F.col("c_name").alias("value"))
    rows.repartition("shelf").write.partitionBy("shelf").text(path)
    found = readers.inventory(spark, path).filter(F.col("path").contains("shelf="))
    return found.select(F.regexp_extract("path", "(shelf=[0-9]+)/", 1).alias("folder"), "size_kb")
