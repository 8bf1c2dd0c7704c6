"""Grid status, placement, demand and the contract files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import domain
from ..operators import aggregate as ag
from ..operators import placement, validate
from ..schemas import FILE_1, FILE_2, FILE_3
from ..sources.sinks import map_layer
from . import spatial
from .registry import query, t


@query("""WITH s AS (SELECT s_suppkey % 40 AS substation_id, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS s_name, s_acctbal / 1000 AS mw, (s_suppkey * 13 % 220)::DOUBLE AS kv FROM supplier)
SELECT substation_id, first(s_name ORDER BY s_suppkey) FILTER (WHERE s_name IS NOT NULL) AS s_name, max(mw) AS mw, max(kv) AS kv, CASE WHEN max(mw) >= 5 THEN 'Sufficient' WHEN max(mw) >= 1 THEN 'Moderate' ELSE 'Congested' END AS grid_status FROM s GROUP BY 1""")
def substation_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("substation_id"), "s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("s_name"), (F.col("s_acctbal") / 1000).alias("mw"), ((F.col("s_suppkey") * 13) % 220).cast("double").alias("kv"))
    return ag.first_and_max(s, "substation_id", ["s_name"], ["mw", "kv"], "s_suppkey").withColumn("grid_status", domain.grid_status(F.col("mw")))


def substation_key(df: DataFrame) -> DataFrame:
    """Grid nodes with a substation_id made from network, name and rounded place."""
    parts = ["distributor_network", "substation_name", F.round("utm_x").cast("bigint").cast("string"), F.round("utm_y").cast("bigint").cast("string")]
    return df.withColumn("substation_id", F.sha2(F.concat_ws("|", *parts), 256))


def _stations(spark: SparkSession, d: str) -> DataFrame:
    """Existing stations: (road, pk)."""
    return t(spark, d, "orders").select((F.col("o_custkey") % 100).alias("road"), ((F.col("o_orderkey") * 7919) % 20000).cast("double").alias("pk"))


_GAPS = """
st AS (SELECT DISTINCT o_custkey % 100 AS road, ((o_orderkey * 7919) % 20000)::DOUBLE AS pk FROM orders),
ld AS (SELECT road, pk AS gap_start, lead(pk) OVER (PARTITION BY road ORDER BY pk) AS gap_end FROM st),
gaps AS (SELECT *, gap_end - gap_start AS gap_km FROM ld WHERE gap_end - gap_start > 150),
pl AS (SELECT road, gap_start, gap_end, (CAST(ceil(gap_km / 150.0::DOUBLE) AS INTEGER) - 1) AS n, unnest(range(1, CAST(ceil(gap_km / 150.0::DOUBLE) AS INTEGER))) AS k, gap_km FROM gaps),
placed AS (SELECT road, gap_start, gap_end, n, k::INTEGER AS k, gap_start + gap_km * k / (n + 1) AS pk_proposed FROM pl)
"""


@query(f"WITH {_GAPS} SELECT * FROM gaps")
def gap_intervals(spark: SparkSession, d: str) -> DataFrame:
    return placement.gap_intervals(_stations(spark, d), "road", "pk", DEFAULT.max_spacing_km)


@query(f"WITH {_GAPS} SELECT * FROM placed")
def greedy_placement(spark: SparkSession, d: str) -> DataFrame:
    return placement.place_stations(gap_intervals(spark, d), "road", DEFAULT.max_spacing_km)


@query("""WITH RECURSIVE st AS (SELECT DISTINCT o_custkey % 100 AS road, ((o_orderkey * 7919) % 20000)::DOUBLE AS pk FROM orders),
nx AS (SELECT a.road, a.pk, coalesce(max(b.pk) FILTER (WHERE b.pk - a.pk <= 600), min(b.pk)) AS nxt FROM st a JOIN st b ON a.road = b.road AND b.pk > a.pk GROUP BY 1, 2),
c AS (SELECT road, min(pk) AS pk FROM st GROUP BY 1 UNION ALL SELECT c.road, nx.nxt FROM c JOIN nx ON c.road = nx.road AND c.pk = nx.pk)
SELECT road, count(*)::INTEGER AS n_chosen, min(pk) AS first_pk, max(pk) AS last_pk FROM c GROUP BY 1""")
def greedy_cover(spark: SparkSession, d: str) -> DataFrame:
    chosen = placement.greedy_cover(_stations(spark, d), "road", "pk", 600.0)
    return chosen.groupBy("road").agg(F.count(F.lit(1)).cast("int").alias("n_chosen"), F.min("pk").alias("first_pk"), F.max("pk").alias("last_pk"))


def _demand_sql(steps: int, reach: int, least: int) -> str:
    """The greedy choice written out step by step, every candidate against all demand that is still open."""
    out = [
        f"""ex AS (SELECT s_suppkey % 100 AS road, (s_suppkey * 104729) % 20000 AS pk FROM supplier),
d0 AS (SELECT * FROM (SELECT o_custkey % 100 AS road, (o_orderkey * 7919) % 20000 AS pk, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS w FROM orders GROUP BY 1, 2) d
  WHERE w > 0 AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.road = d.road AND ex.pk BETWEEN d.pk - {reach} AND d.pk + {reach})),
c AS (SELECT DISTINCT c_custkey % 100 AS road, (c_custkey * 15485863) % 20000 AS pk FROM customer)"""
    ]
    for k in range(1, steps + 1):
        out.append(
            f"""p{k} AS (SELECT road, pk, gain FROM (SELECT c.road, c.pk, sum(w)::BIGINT AS gain, row_number() OVER (PARTITION BY c.road ORDER BY sum(w) DESC, c.pk) AS rn
  FROM c JOIN d{k - 1} d ON c.road = d.road AND d.pk BETWEEN c.pk - {reach} AND c.pk + {reach} GROUP BY 1, 2) WHERE rn = 1 AND gain >= {least}),
d{k} AS (SELECT d.* FROM d{k - 1} d WHERE NOT EXISTS (SELECT 1 FROM p{k} p WHERE p.road = d.road AND d.pk BETWEEN p.pk - {reach} AND p.pk + {reach}))"""
        )
    rows = " UNION ALL ".join(f"SELECT road, {k} AS step, pk::DOUBLE AS pk, gain FROM p{k}" for k in range(1, steps + 1))
    return f"WITH {', '.join(out)} {rows}"


@query(_demand_sql(6, 75, 1000000))
def demand_placement(spark: SparkSession, d: str) -> DataFrame:
    """Six stations a road at most, at the candidates that cover the most demand beyond the reach of existing stations."""
    road_of = lambda key: (F.col(key) % 100).alias("road")
    demand = t(spark, d, "orders").select(road_of("o_custkey"), ((F.col("o_orderkey") * 7919) % 20000).alias("pk"), ag.cents(F.col("o_totalprice")).alias("cents"))
    sites = t(spark, d, "customer").select(road_of("c_custkey"), ((F.col("c_custkey") * 15485863) % 20000).alias("pk"))
    existing = t(spark, d, "supplier").select(road_of("s_suppkey"), ((F.col("s_suppkey") * 104729) % 20000).cast("double").alias("pk"))
    return placement.place_by_demand(demand, sites, "road", "pk", "cents", DEFAULT.max_spacing_km / 2, 6, 1_000_000, existing)


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS imd, list_value('AP-7','A-7','A-8','AP-9','N-340')[l_suppkey % 5 + 1] AS road, month(l_shipdate) AS month FROM lineitem),
d AS (SELECT *, CASE WHEN month IN (7, 8) THEN CASE WHEN road IN ('AP-7','A-7') THEN 2.0::DOUBLE WHEN road IN ('A-8','AP-9') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 1.0::DOUBLE END AS mult FROM m),
e AS (SELECT *, imd * (2498159.0::DOUBLE / 25000000.0::DOUBLE) * mult AS ev FROM d),
c AS (SELECT *, least(greatest(ceil(ev * 0.07::DOUBLE * 0.4::DOUBLE / 18.0::DOUBLE), 2), 8)::INTEGER AS n FROM e)
SELECT road, month, n AS n_chargers, count(*) AS segments, (n * 150)::BIGINT AS demand_kw FROM c GROUP BY 1, 2, 3""")
def chargers_needed(spark: SparkSession, d: str) -> DataFrame:
    road = F.get(F.array(*map(F.lit, ["AP-7", "A-7", "A-8", "AP-9", "N-340"])), (F.col("l_suppkey") % 5).cast("int"))
    m = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("imd"), road.alias("road"), F.month("l_shipdate").alias("month"))
    ev = domain.ev_traffic(F.col("imd"), F.lit(2498159.0), domain.seasonal_multiplier(F.col("road"), F.col("month")))
    c = m.select("road", F.col("month").cast("bigint").alias("month"), domain.chargers_needed(ev).alias("n_chargers"))
    return c.groupBy("road", "month", "n_chargers").agg(F.count(F.lit(1)).alias("segments")).withColumn("demand_kw", domain.demand_kw(F.col("n_chargers")).cast("bigint"))


def _proposed(spark: SparkSession, d: str) -> DataFrame:
    """File 2 with the distributor: a proposed station at each customer's place, its status from the nearest substation."""
    st = spatial.nearest_within_radius_status(spark, d)
    pts = spatial.customers_ll(spark, d)
    n = domain.chargers_needed((F.col("point_id") * 37 % 9000).cast("double"))
    net = F.get(F.array(*map(F.lit, ["i-DE", "Endesa", "Viesgo"])), (F.coalesce("site_id", F.lit(0)) % 3).cast("int"))
    return pts.join(st, "point_id").select(F.concat(F.lit("LOC-"), F.lpad(F.col("point_id").cast("string"), 8, "0")).alias("location_id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.concat(F.lit("R-"), (F.col("point_id") % 50).cast("string")).alias("route_segment"), n.alias("n_chargers_proposed"), "grid_status", net.alias("distributor_network"))


_PROPOSED = f"""WITH {spatial._LL}, ps AS (SELECT 'LOC-' || lpad(CAST(pt.point_id AS VARCHAR), 8, '0') AS location_id, lat AS latitude, lon AS longitude, 'R-' || CAST(pt.point_id % 50 AS VARCHAR) AS route_segment,
least(greatest(ceil((pt.point_id * 37 % 9000)::DOUBLE * 0.07::DOUBLE * 0.4::DOUBLE / 18.0::DOUBLE), 2), 8)::INTEGER AS n_chargers_proposed,
CASE WHEN mw >= 5 THEN 'Sufficient' WHEN mw >= 1 THEN 'Moderate' ELSE 'Congested' END AS grid_status, list_value('i-DE','Endesa','Viesgo')[coalesce(site_id, 0) % 3 + 1] AS distributor_network FROM pt LEFT JOIN nn USING (point_id))"""


@query(f"{_PROPOSED} SELECT location_id, latitude, longitude, route_segment, n_chargers_proposed, grid_status FROM ps")
def contract_file2(spark: SparkSession, d: str) -> DataFrame:
    return _proposed(spark, d).select(FILE_2)


@query(f"{_PROPOSED} SELECT location_id AS bottleneck_id, latitude, longitude, route_segment, distributor_network, n_chargers_proposed * 150 AS estimated_demand_kw, grid_status FROM ps WHERE grid_status IN ('Moderate', 'Congested')")
def contract_file3(spark: SparkSession, d: str) -> DataFrame:
    return _file3(_proposed(spark, d))


def _file3(proposed: DataFrame) -> DataFrame:
    p = proposed.filter(domain.is_friction(F.col("grid_status")))
    return p.withColumn("bottleneck_id", F.col("location_id")).withColumn("estimated_demand_kw", domain.demand_kw(F.col("n_chargers_proposed"))).select(FILE_3)


@query(f"""{_PROPOSED} SELECT count(*) AS total_proposed_stations, (SELECT count(*) FROM supplier) AS total_existing_stations_baseline, count(*) FILTER (WHERE grid_status <> 'Sufficient') AS total_friction_points, (SELECT count(*) FROM orders) AS total_ev_projected_2027 FROM ps""")
def contract_file1(spark: SparkSession, d: str) -> DataFrame:
    return _file1(spark, d, _proposed(spark, d))


def _file1(spark: SparkSession, d: str, proposed: DataFrame) -> DataFrame:
    own = proposed.agg(F.count(F.lit(1)).alias("total_proposed_stations"), F.count_if(domain.is_friction(F.col("grid_status"))).alias("total_friction_points"))
    existing = t(spark, d, "supplier").agg(F.count(F.lit(1)).alias("total_existing_stations_baseline"))
    ev = t(spark, d, "orders").agg(F.count(F.lit(1)).alias("total_ev_projected_2027"))
    return own.crossJoin(existing).crossJoin(ev).select(FILE_1)  # one row each


@query(f"""{_PROPOSED}, k AS (SELECT location_id AS row_id, CAST(substr(location_id, 5) AS INTEGER) AS k, grid_status <> 'Sufficient' AS friction FROM ps)
SELECT 'file_1 has one row' AS rule, '2' AS row_id
UNION ALL SELECT 'file_2 status in domain', row_id FROM k WHERE k % 7 = 0 OR k % 11 = 0
UNION ALL SELECT 'file_3 status is friction', row_id FROM k WHERE friction AND k % 17 = 0
UNION ALL SELECT 'file_3 distributor in domain', row_id FROM k WHERE friction AND k % 5 = 0
UNION ALL SELECT 'file_3 demand is chargers by power', row_id FROM k WHERE friction AND k % 13 = 0""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """The contract files with a rule broken in every few rows, so that each rule has something to find."""

    def broken(df: DataFrame, ident: str, column: str, every: int, value) -> DataFrame:
        number = F.substring(ident, 5, 20).cast("int")
        return df.withColumn(column, F.when(number % every == 0, value).otherwise(F.col(column)))

    proposed = _proposed(spark, d)  # the nearest substations are found once
    one, three = _file1(spark, d, proposed), _file3(proposed)
    two = broken(broken(proposed.select(FILE_2), "location_id", "grid_status", 7, F.lit("Unknown")), "location_id", "grid_status", 11, F.lit(None))
    for column, every, value in (("grid_status", 17, F.lit("Sufficient")), ("distributor_network", 5, F.lit("Other")), ("estimated_demand_kw", 13, F.col("estimated_demand_kw") + 1)):
        three = broken(three, "bottleneck_id", column, every, value)
    return validate.violations(one.union(one), two, three)


@query(f"""{_PROPOSED} SELECT location_id, latitude, longitude, CASE grid_status WHEN 'Sufficient' THEN 'green' WHEN 'Moderate' THEN 'orange' ELSE 'red' END AS color, 'location_id: ' || location_id || '; grid_status: ' || grid_status AS popup, grid_status FROM ps""")
def map_points(spark: SparkSession, d: str) -> DataFrame:
    return map_layer(contract_file2(spark, d).select("location_id", "latitude", "longitude", "grid_status"))


@query("SELECT year(o_orderdate) AS year, count(*) AS vehicles, (count(*) * 16)::BIGINT AS co2_saving_t FROM orders GROUP BY 1")
def co2_saving(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("vehicles"))
    return n.withColumn("co2_saving_t", domain.co2_saving_t(F.col("vehicles")))


@query("""SELECT count(*) AS chargers, count(*) FILTER (WHERE s_acctbal / 50 >= 50) AS fast50, count(*) FILTER (WHERE s_acctbal / 50 >= 150) AS fast150, count(*) FILTER (WHERE s_acctbal / 50 >= 150) / CAST(count(*) AS DOUBLE) AS share150 FROM supplier""")
def charger_kpis(spark: SparkSession, d: str) -> DataFrame:
    kw = F.col("s_acctbal") / 50
    slow, fast = DEFAULT.fast_kw
    return t(spark, d, "supplier").agg(F.count(F.lit(1)).alias("chargers"), F.count_if(kw >= slow).alias("fast50"), F.count_if(kw >= fast).alias("fast150"), (F.count_if(kw >= fast) / F.count(F.lit(1)).cast("double")).alias("share150"))
