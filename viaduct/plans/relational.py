"""Parsing, cleaning, relational and window queries over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import aggregate as ag
from ..operators import joins, window
from ..schemas import PROPULSION, PROVINCES
from .registry import query, t

ROADS = ["AP-7", "A-7", "AC-12", "N-340", "M-40", "123"]
_SQL_ROAD = "list_value('AP-7','A-7','AC-12','N-340','M-40','123')[(p_partkey % 6) + 1]"


@query(f"""
WITH r AS (SELECT {_SQL_ROAD} AS road FROM part)
SELECT nullif(regexp_extract(road, '^(AP|A|N|[A-Z]+)', 1), '') AS road_prefix, regexp_matches(road, '^(AP-|A-|N-)') AS interurban, count(*) AS n
FROM r GROUP BY 1, 2 HAVING road_prefix IS NOT NULL
""")
def road_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    r = t(spark, d, "part").select(F.get(F.array(*map(F.lit, ROADS)), (F.col("p_partkey") % 6).cast("int")).alias("road"))
    return ag.value_counts(r.select(text.road_prefix(F.col("road")).alias("road_prefix"), text.is_interurban(F.col("road")).alias("interurban")), "road_prefix", "interurban", name="n")


def _spanish(key: Column, price: Column) -> Column:
    c = F.round(price * 100).cast("bigint")
    whole, part = F.floor(c / 100).cast("bigint"), F.lpad((c % 100).cast("string"), 2, "0")
    grouped = F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(","), part)
    plain = F.concat(whole.cast("string"), F.lit(","), part)
    dotted = F.concat(whole.cast("string"), F.lit("."), part)
    return F.when(key % 6 == 0, grouped).when(key % 6 == 1, plain).when(key % 6 == 2, dotted).when(key % 6 == 3, " ").when(key % 6 == 4, F.concat(F.lit("x"), plain)).otherwise(F.concat(F.lit("  "), plain, F.lit("\t")))


_SQL_SPANISH = """
p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part),
s AS (SELECT p_partkey, CASE p_partkey % 6
  WHEN 0 THEN CAST(c // 100 // 1000 AS VARCHAR) || '.' || lpad(CAST(c // 100 % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
  WHEN 1 THEN CAST(c // 100 AS VARCHAR) || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
  WHEN 2 THEN CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
  WHEN 3 THEN ' ' WHEN 4 THEN 'x' || CAST(c // 100 AS VARCHAR) || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
  ELSE CAST(c // 100 AS VARCHAR) || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS v FROM p)
"""


@query(f"""
WITH {_SQL_SPANISH}
SELECT p_partkey, TRY_CAST(CASE WHEN contains(v, '.') AND contains(v, ',') THEN replace(replace(v, '.', ''), ',', '.') ELSE replace(v, ',', '.') END AS DOUBLE) AS decimal_value,
  TRY_CAST(replace(replace(v, '.', ''), ',', '.') AS DOUBLE) AS grouped_value FROM s
""")
def spanish_number_parse(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "part").select("p_partkey", _spanish(F.col("p_partkey"), F.col("p_retailprice")).alias("v"))
    return s.select("p_partkey", text.spanish_float(F.col("v")).alias("decimal_value"), text.grouped_float(F.col("v")).alias("grouped_value"))


@query("""
SELECT 'customer' AS source, c_custkey AS id, trim(c_name) AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, trim(s_name) FROM supplier UNION ALL SELECT 'part', p_partkey, trim(p_name) FROM part
""")
def unify_sources(spark: SparkSession, d: str) -> DataFrame:
    spec = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}
    frames = [t(spark, d, n).select(F.lit(n).alias("source"), F.col(k).alias("id"), text.strip(F.col(v)).alias("name")) for n, (k, v) in spec.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE list_value('Araba/Álava','Albacete','Alicante/Alacant','Almería')[n_nationkey % 4 + 1] END AS province,
  CASE WHEN length(CAST(n_nationkey AS VARCHAR)) < 5 THEN lpad(CAST(n_nationkey AS VARCHAR), 5, '0') ELSE CAST(n_nationkey AS VARCHAR) END AS code FROM nation
""")
def province_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    raw = F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).otherwise(F.concat((F.col("n_nationkey") % 4 + 1).cast("string"), F.lit(".0")))
    return n.select("n_nationkey", text.province_name(raw, PROVINCES).alias("province"), text.zero_padded(F.col("n_nationkey").cast("string"), 5).alias("code"))


_REG = """
r AS (SELECT o_orderkey, strftime(o_orderdate, '%d%m%Y') AS fec, CAST(o_orderkey % 14 AS VARCHAR) AS prop, CASE WHEN o_custkey % 3 = 0 THEN '25' ELSE '40' END AS tipo,
  list_value('1','5','B','2')[o_orderkey % 4 + 1] AS tramite, o_orderpriority AS marca, o_orderstatus AS modelo FROM orders),
c AS (SELECT o_orderkey, CAST(right(fec, 4) AS INTEGER) AS ano, CAST(substring(fec, length(fec) - 5, 2) AS INTEGER) AS mes, marca, modelo,
  CASE prop WHEN '0' THEN 'Gasolina' WHEN '1' THEN 'Diesel' WHEN '2' THEN 'Eléctrico' WHEN '3' THEN 'Otros' WHEN '4' THEN 'Butano' WHEN '5' THEN 'Solar' WHEN '6' THEN 'Gas Licuado de Petróleo'
    WHEN '7' THEN 'Gas Natural Comprimido' WHEN '8' THEN 'Gas Natural Licuado' WHEN '9' THEN 'Hidrógeno' END AS propulsion
  FROM r WHERE tipo = '40' AND tramite IN ('1','5','B')),
reg AS (SELECT * FROM c WHERE (ano > 1996 OR (ano = 1996 AND mes >= 3)) AND propulsion IS NOT NULL)
"""


def registrations(spark: SparkSession, d: str) -> DataFrame:
    """Orders dressed as vehicle registrations and cleaned: (o_orderkey, ano, mes, marca, modelo, propulsion)."""
    o = t(spark, d, "orders")
    raw = o.select(
        "o_orderkey", F.date_format("o_orderdate", "ddMMyyyy").alias("fec"), (F.col("o_orderkey") % 14).cast("string").alias("prop"), F.when(F.col("o_custkey") % 3 == 0, "25").otherwise("40").alias("tipo"),
        F.get(F.array(*map(F.lit, "15B2")), (F.col("o_orderkey") % 4).cast("int")).alias("tramite"), F.col("o_orderpriority").alias("marca"), F.col("o_orderstatus").alias("modelo"),
    ).filter((F.col("tipo") == "40") & F.col("tramite").isin("1", "5", "B"))
    year, month = F.coalesce(text.from_right(F.col("fec"), 4, 4).try_cast("int"), F.lit(0)), F.coalesce(text.from_right(F.col("fec"), 6, 2).try_cast("int"), F.lit(0))
    clean = raw.select("o_orderkey", year.alias("ano"), month.alias("mes"), "marca", "modelo", F.try_element_at(text.literal_map(PROPULSION), F.col("prop")).alias("propulsion"))
    return clean.filter(dates.on_or_after(F.col("ano"), F.col("mes"), 1996, 3) & F.col("propulsion").isNotNull())


@query(f"WITH {_REG} SELECT * FROM reg")
def registrations_clean(spark: SparkSession, d: str) -> DataFrame:
    return registrations(spark, d)


@query(f"WITH {_REG} SELECT marca, count(*) AS n FROM reg GROUP BY 1")
def brand_counts(spark: SparkSession, d: str) -> DataFrame:
    return ag.value_counts(registrations(spark, d), "marca", name="n")


@query(f"WITH {_REG} SELECT marca, modelo, count(*) AS n FROM reg GROUP BY 1, 2 ORDER BY n DESC, marca, modelo LIMIT 10")
def top10_models(spark: SparkSession, d: str) -> DataFrame:
    return ag.top_k(ag.value_counts(registrations(spark, d), "marca", "modelo", name="n"), 10, "n", "marca", "modelo")


@query(f"""WITH {_REG}, b AS (SELECT CASE WHEN propulsion IN ('Gasolina','Diesel','Eléctrico') THEN propulsion ELSE 'Otros' END AS propulsion FROM reg)
SELECT propulsion, count(*) AS n, count(*) / CAST((SELECT count(*) FROM b) AS DOUBLE) * 100 AS pct FROM b GROUP BY 1""")
def share_with_other(spark: SparkSession, d: str) -> DataFrame:
    b = registrations(spark, d).select(ag.other_bucket(F.col("propulsion"), ["Gasolina", "Diesel", "Eléctrico"]).alias("propulsion"))
    n = b.groupBy("propulsion").agg(F.count(F.lit(1)).alias("n"))
    whole = n.agg(F.sum("n").alias("whole"))
    return n.crossJoin(F.broadcast(whole)).select("propulsion", "n", (F.col("n") / F.col("whole").cast("double") * 100).alias("pct"))


@query(f"""WITH {_REG}, b AS (SELECT ano, mes, CASE WHEN propulsion IN ('Gasolina','Diesel','Eléctrico') THEN propulsion ELSE 'Otros' END AS p FROM reg),
q AS (SELECT ano, mes, count(*) FILTER (WHERE p = 'Gasolina') AS "Gasolina", count(*) FILTER (WHERE p = 'Diesel') AS "Diesel", count(*) FILTER (WHERE p = 'Eléctrico') AS "Eléctrico", count(*) FILTER (WHERE p = 'Otros') AS "Otros" FROM b GROUP BY 1, 2)
SELECT *, "Gasolina" + "Diesel" + "Eléctrico" + "Otros" AS "TOTAL", "Gasolina" / CAST("Gasolina" + "Diesel" + "Eléctrico" + "Otros" AS DOUBLE) * 100 AS "Gasolina_pct", "Diesel" / CAST("Gasolina" + "Diesel" + "Eléctrico" + "Otros" AS DOUBLE) * 100 AS "Diesel_pct",
 "Eléctrico" / CAST("Gasolina" + "Diesel" + "Eléctrico" + "Otros" AS DOUBLE) * 100 AS "Eléctrico_pct", "Otros" / CAST("Gasolina" + "Diesel" + "Eléctrico" + "Otros" AS DOUBLE) * 100 AS "Otros_pct" FROM q""")
def month_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["Gasolina", "Diesel", "Eléctrico", "Otros"]
    b = registrations(spark, d).select("ano", "mes", ag.other_bucket(F.col("propulsion"), kinds[:3]).alias("p"))
    n = b.groupBy("ano", "mes", "p").agg(F.count(F.lit(1)).alias("n"))
    return ag.shares(ag.pivot_sum(n, ["ano", "mes"], "p", kinds, "n"), kinds)


@query(f"""WITH {_REG} SELECT mes, CAST(count(*) FILTER (WHERE ano = 1997) AS DOUBLE) AS y1997, CAST(count(*) FILTER (WHERE ano = 1998) AS DOUBLE) AS y1998, CAST(count(*) FILTER (WHERE ano = 1999) AS DOUBLE) AS y1999
FROM reg WHERE propulsion = 'Eléctrico' GROUP BY 1""")
def month_year_heatmap(spark: SparkSession, d: str) -> DataFrame:
    n = registrations(spark, d).filter(F.col("propulsion") == "Eléctrico").groupBy("mes", "ano").agg(F.count(F.lit(1)).alias("n"))
    p = ag.pivot_sum(n, ["mes"], "ano", [1997, 1998, 1999], "n")
    return p.select("mes", *(F.col(str(y)).cast("double").alias(f"y{y}") for y in (1997, 1998, 1999)))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT strftime(month, '%Y-%m-%d') AS month, n, CASE WHEN count(n) OVER w >= 6 THEN sum(n) OVER w / CAST(count(n) OVER w AS DOUBLE) END AS moving_avg FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""")
def centered_moving_average(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return window.centred_average(m, "n", "moving_avg", "month").withColumn("month", F.col("month").cast("string"))


@query("""SELECT strftime(ts, '%Y_%m') AS year_month, count(*) FILTER (WHERE event_type = 'purchase') AS ev_registrations, strftime(date_trunc('month', min(ts)), '%Y-%m-%d') AS date FROM events GROUP BY 1""")
def monthly_event_counts(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select(F.date_format("ts", "yyyy_MM").alias("year_month"), (F.col("event_type") == "purchase").alias("ev"))
    return e.groupBy("year_month").agg(F.count_if("ev").alias("ev_registrations")).withColumn("date", dates.month_start(F.col("year_month")).cast("string"))


@query("""WITH a AS (SELECT ts, dayofweek(ts) AS dayz, date_trunc('hour', ts) AS slot, CAST(round(value * 100) AS BIGINT) AS v FROM events),
k AS (SELECT * FROM a WHERE slot IN (SELECT slot FROM a GROUP BY 1 HAVING count(*) > 1)),
s AS (SELECT dayz, hour(slot) AS hour, sum(v)::BIGINT AS victims FROM k GROUP BY 1, 2)
SELECT dayz, hour, victims, sum(victims) OVER (ORDER BY dayz, hour ROWS UNBOUNDED PRECEDING)::BIGINT AS victims_acc, row_number() OVER (ORDER BY dayz, hour) - 1 AS idx FROM s""")
def weekday_hour_victims(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select((F.dayofweek("ts") - 1).cast("bigint").alias("dayz"), F.date_trunc("hour", "ts").alias("slot"), ag.cents(F.col("value")).alias("v"))
    s = window.duplicated(e, "slot").groupBy("dayz", F.hour("slot").cast("bigint").alias("hour")).agg(F.sum("v").alias("victims"))
    out = window.running_total(s, "victims", "victims_acc", "dayz", "hour")
    return joins.numbered(out, "idx", "dayz", "hour")


@query("SELECT hour(ts) AS hour, min(value) AS min_value, max(value) AS max_value, strftime(make_timestamp(2024, 1, 1, hour(ts), 0, 0), '%H') AS label FROM events GROUP BY 1, 4")
def hour_envelope(spark: SparkSession, d: str) -> DataFrame:
    e = ag.hour_envelope(t(spark, d, "events"), "ts", "value")
    return e.select(F.col("hour").cast("bigint").alias("hour"), "min_value", "max_value", F.date_format(dates.hour_on_first(F.make_timestamp_ntz(F.lit(2024), F.lit(5), F.lit(9), F.col("hour"), F.lit(30), F.lit(0))), "HH").alias("label"))


@query("""SELECT n_nationkey, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE substring(c_mktsegment, 1, 2) = 'BU' GROUP BY 1) ON c_nationkey = n_nationkey""")
def municipality_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "customer").filter(F.col("c_mktsegment").startswith("BU")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return joins.zero_filled(t(spark, d, "nation").select("n_nationkey"), n, "n_nationkey", "n")


@query("""WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000), c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k FROM customer)
SELECT c_custkey, k IS NOT NULL AND k IN (SELECT o_custkey FROM b) AS has_big_order FROM c""")
def semi_anti_split(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k"))
    big = t(spark, d, "orders").filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("k"))
    yes, no = joins.semi_anti(c, big, "k")
    return yes.select("c_custkey", F.lit(True).alias("has_big_order")).union(no.select("c_custkey", F.lit(False).alias("has_big_order")))


@query("""WITH p AS (SELECT lower(p_brand) AS brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1), f AS (SELECT lower(p_brand) AS brand, count(*) AS parts FROM part GROUP BY 1)
SELECT brand, n, parts, n / CAST(parts AS DOUBLE) AS ratio FROM p JOIN f USING (brand)""")
def ratio_by_group(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("brand"))
    by_part = t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    pos = by_part.join(part, "p_partkey").groupBy("brand").agg(F.sum("n").alias("n"))
    return joins.ratio(pos, part.select("brand", F.lit(1).alias("parts")), ["brand"], "n", "parts")


@query("""SELECT count(l_quantity) AS count, sum(l_quantity) / CAST(count(*) AS DOUBLE) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS max FROM lineitem""")
def describe_stats(spark: SparkSession, d: str) -> DataFrame:
    return ag.describe(t(spark, d, "lineitem"), "l_quantity").withColumn("std", F.round("std", 6))


@query("""SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_quantity >= 25) AS n25, count(*) FILTER (WHERE l_quantity >= 25) / CAST(count(*) AS DOUBLE) AS share25, median(l_quantity) AS median_quantity FROM lineitem""")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    fast = F.col("l_quantity") >= 25
    return t(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(fast).alias("n25"), (F.count_if(fast) / F.count(F.lit(1)).cast("double")).alias("share25"), F.median("l_quantity").alias("median_quantity"))


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return ag.distinct_first(t(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS segment_id FROM orders")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    return joins.numbered(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "segment_id", "o_orderdate", "o_orderkey").select("o_orderkey", F.col("segment_id").cast("bigint").alias("segment_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages""")
def html_fields(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages")
    return p.select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("")).alias("host"), F.regexp_count("html", F.lit("<p[ >]")).cast("bigint").alias("paragraphs"))


@query("SELECT o_orderkey, o_orderstatus AS status, strftime(o_orderdate, '%d%m%Y') AS fecha, trim(substring(o_orderpriority, 1, 8)) AS prioridad FROM orders")
def fixed_width_decode(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    line = F.concat(F.rpad(F.col("o_orderkey").cast("string"), 12, " "), F.rpad("o_orderstatus", 3, " "), F.date_format("o_orderdate", "ddMMyyyy"), F.rpad("o_orderpriority", 8, " "))
    f = o.select(line.alias("value")).select(*text.fixed_fields(F.col("value"), [("key", 12), ("status", 3), ("fecha", 8), ("prioridad", 8)]))
    return f.select(F.col("key").cast("bigint").alias("o_orderkey"), "status", "fecha", "prioridad")


@query("""SELECT n_name, year(o_orderdate) AS year, (sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*))::BIGINT AS mean_cents, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def group_ten_period_mean(spark: SparkSession, d: str) -> DataFrame:
    by_customer = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).agg(F.sum(ag.cents(F.col("o_totalprice"))).alias("s"), F.count(F.lit(1)).alias("n"))
    j = by_customer.join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return j.groupBy("n_name", F.col("year").cast("bigint").alias("year")).agg(F.floor(F.expr("sum(s) div sum(n)")).alias("mean_cents"), F.sum("n").alias("n"))


@query("""WITH m AS (SELECT month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT count(*) / 12.0::DOUBLE AS mean FROM orders)
SELECT month, n, round(n / mean, 4) AS seasonal_multiplier FROM m, y""")
def seasonal_multiplier(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "orders").groupBy(F.month("o_orderdate").cast("bigint").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    y = m.agg((F.sum("n") / F.lit(12.0)).alias("mean"))
    return m.crossJoin(F.broadcast(y)).select("month", "n", F.round(F.col("n") / F.col("mean"), 4).alias("seasonal_multiplier"))


@query("""SELECT vec_id, label FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 3)""")
def top_labels_semi(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings").select("vec_id", "label")
    top = ag.top_k(ag.value_counts(e, "label", name="n"), 3, "n", "label")
    return e.join(top.select("label"), "label", "left_semi")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS c FROM embeddings, q WHERE vec_id <> 0)
SELECT vec_id, round(c, 5) AS similarity FROM s ORDER BY round(c, 5) DESC, vec_id LIMIT 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.filter("vec_id = 0").select(F.col("v").alias("q")).limit(1)  # the one query vector
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with("v", "q", lambda a, b: a * b))
    norm = F.sqrt(total(F.transform("v", lambda a: a * a))) * F.sqrt(total(F.transform("q", lambda a: a * a)))
    s = e.filter("vec_id <> 0").crossJoin(F.broadcast(one)).select("vec_id", F.round(dot / norm, 5).alias("similarity"))
    return ag.top_k(s, 10, "similarity", "vec_id")


@query("""SELECT coalesce(o_orderstatus, 'All') AS o_orderstatus, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS "1-URGENT", count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS "2-HIGH", count(*) FILTER (WHERE o_orderpriority LIKE '3%') AS "3-MEDIUM",
count(*) FILTER (WHERE o_orderpriority LIKE '4%') AS "4-NOT SPECIFIED", count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS "5-LOW", count(*) AS "All" FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def status_crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    return ag.crosstab_margins(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
