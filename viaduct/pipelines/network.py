"""From roads, counts and charging sites to coverage gaps, proposals and the three contract files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import domain, geo, text
from ..operators import aggregate as ag
from ..operators import joins, placement, shapes, validate, window
from ..operators.store import written
from ..schemas import FILE_1, FILE_2, FILE_3


def substations(nodes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Grid nodes by substation: first attributes, greatest capacity and voltage, status."""
    key = F.sha2(F.concat_ws("|", "distributor_network", "substation_name", F.round("utm_x").cast("bigint").cast("string"), F.round("utm_y").cast("bigint").cast("string")), 256)
    order = F.struct("provincia", "municipio", "latitude", "longitude")
    keyed = nodes.withColumns({"substation_id": key, "__order": order})
    out = ag.first_and_max(keyed, "substation_id", ["substation_name", "provincia", "municipio", "distributor_network", "latitude", "longitude"], ["available_capacity_mw", "voltage_kv"], "__order")
    status = domain.grid_status(F.col("available_capacity_mw"), cfg)
    return out.withColumns({"grid_status": status, "is_friction": domain.is_friction(status)})


def road_segments(roads: DataFrame, stations: DataFrame, trunk: DataFrame | None = None, provinces: DataFrame | None = None, cfg: Config = DEFAULT, bin_km: float = 10.0) -> DataFrame:
    """Interurban segments with id, traffic (means of their stations, then medians), trunk flag, spacing and province."""
    seg = roads.filter(text.is_interurban(F.col("Carretera")))
    seg = joins.numbered(seg, "segment_id", "Carretera", "PK_inicio", "PK_fin", F.to_json("geometry"))
    seg = seg.withColumns({"road_prefix": text.road_prefix(F.col("Carretera")), "length_km": F.col("Longitud") / 1000.0, "Carretera_clean": text.strip(F.col("Carretera"))})
    st = stations.withColumn("Carretera_clean", text.strip(F.col("Carretera"))).select("Carretera_clean", "PK", "IMD_total", "IMD_ligeros", "IMD_pesados")
    met = joins.interval_join(st, seg.select("segment_id", "Carretera_clean", "PK_inicio", "PK_fin"), ["Carretera_clean"], "PK", "PK_inicio", "PK_fin", bin_km)
    means = met.groupBy("segment_id").agg(F.avg("IMD_total").alias("imd_total"), F.avg("IMD_ligeros").alias("imd_ligeros"), F.avg("IMD_pesados").alias("imd_pesados"), F.count("IMD_total").alias("n_stations"))
    seg = seg.join(means, "segment_id", "left").withColumn("n_stations", F.coalesce("n_stations", F.lit(0)))
    seg = window.impute_median(seg, "Carretera_clean", "imd_total", "imd_total")
    if "TENT" in seg.columns:
        seg = seg.withColumn("is_tent", F.coalesce(F.col("TENT") != "", F.lit(False)))
    elif trunk is not None:
        seg = joins.flagged(seg, trunk.select(text.strip(F.col("Carretera")).alias("Carretera_clean")), "Carretera_clean", "is_tent")
    else:
        seg = seg.withColumn("is_tent", F.lit(False))
    seg = seg.withColumn("max_spacing_km", domain.spacing_km(F.col("is_tent"), cfg))
    if provinces is not None:
        mid = shapes.centroids(shapes.edges_of_lines(seg, "segment_id", "geometry"), "segment_id").withColumnRenamed("segment_id", "point_id")
        place = joins.point_in_polygon(mid, shapes.edges_of_polygons(provinces, "cod_prov", "rings"), 1.0, poly_id="cod_prov")
        seg = seg.join(place.select(F.col("point_id").alias("segment_id"), "cod_prov"), "segment_id", "left")
    return seg


def metric_edges(segments: DataFrame) -> DataFrame:
    """(edge_id, edge_no, x1, y1, x2, y2) in metres; edge_id is the segment."""
    e = shapes.edges_of_lines(segments, "segment_id", "geometry")
    x1, y1 = geo.to_utm(F.col("y1"), F.col("x1"))
    x2, y2 = geo.to_utm(F.col("y2"), F.col("x2"))
    return e.select(F.col("segment_id").alias("edge_id"), "edge_no", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def interurban_chargers(sites: DataFrame, segments: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Charging sites, one for each id and inside the country's box, within the buffer of a segment, with the nearest one."""
    own = ag.distinct_first(sites, ["site_id"], "latitude", "longitude", "name").filter(geo.in_box(F.col("latitude"), F.col("longitude"), (27.0, 44.0), (-19.0, 5.0)))
    x, y = geo.to_utm(F.col("latitude"), F.col("longitude"))
    pts = own.withColumns({"point_id": F.col("site_id"), "x": x, "y": y})
    near = joins.nearest_edge(pts, metric_edges(segments), cfg.buffer_m, most=cfg.buffer_m).filter(F.col("dist") < cfg.buffer_m)
    best = near.select(F.col("point_id").alias("site_id"), F.col("edge_id").alias("segment_id"), F.col("dist").alias("dist_to_road_m"))
    attrs = segments.select("segment_id", F.col("Carretera").alias("nearest_road"), "road_prefix", "is_tent")
    return own.join(best, "site_id").join(attrs, "segment_id")


def segment_coverage(segments: DataFrame, chargers: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Segments with the distance from their middle to the nearest charger; a gap is more than the spacing, or no charger at all."""
    mid = shapes.centroids(metric_edges(segments), "edge_id").withColumnRenamed("edge_id", "point_id")
    x, y = geo.to_utm(F.col("latitude"), F.col("longitude"))
    spots = chargers.select(F.col("site_id").alias("edge_id"), x.alias("x1"), y.alias("y1")).withColumns({"x2": F.col("x1"), "y2": F.col("y1")})
    near = joins.nearest_edge(mid, spots, 10_000.0).select(F.col("point_id").alias("segment_id"), F.col("dist").alias("dist_to_charger_m"))
    none = chargers.agg((F.count(F.lit(1)) == 0).alias("__none"))  # one row
    out = segments.join(near, "segment_id", "left").withColumn("dist_to_charger_km", F.col("dist_to_charger_m") / 1000.0).crossJoin(F.broadcast(none))
    return out.withColumn("is_gap", F.coalesce(F.col("dist_to_charger_km") > F.col("max_spacing_km"), F.col("__none"))).drop("__none")


def demand(segments: DataFrame, fleet: float, month: int, cfg: Config = DEFAULT, multipliers: DataFrame | None = None) -> DataFrame:
    """(segment_id, route_segment, daily_ev_traffic_2027, n_chargers_needed, is_coastal, seasonal_multiplier).

    multipliers (cod_prov, seasonal_multiplier) take the place of those by road where given."""
    road = F.col("Carretera_clean")
    rows = segments.withColumn("seasonal_multiplier", domain.seasonal_multiplier(road, F.lit(month), cfg))
    if multipliers is not None:
        rows = rows.drop("seasonal_multiplier").join(multipliers.select("cod_prov", "seasonal_multiplier"), "cod_prov", "left").withColumn("seasonal_multiplier", F.coalesce("seasonal_multiplier", F.lit(1.0)))
    ev = domain.ev_traffic(F.col("imd_total"), F.lit(float(fleet)), F.col("seasonal_multiplier"), cfg)
    return rows.select("segment_id", road.alias("route_segment"), ev.alias("daily_ev_traffic_2027"), domain.chargers_needed(ev, cfg).alias("n_chargers_needed"), road.isin(*cfg.peak_multipliers).alias("is_coastal"), "seasonal_multiplier")


def located(segments: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (segment_id, share of the segment's length) with longitude and latitude on its line."""
    e = shapes.edges_of_lines(segments, "segment_id", "geometry")
    l = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    w = Window.partitionBy("segment_id").orderBy("edge_no")
    e = e.withColumn("l", l).withColumn("until", F.sum("l").over(w)).withColumn("whole", F.sum("l").over(Window.partitionBy("segment_id")))
    hit = targets.join(e, "segment_id").withColumn("at", F.col("share") * F.col("whole")).filter(F.col("at") <= F.col("until") + 1e-12)
    first = hit.groupBy("location_id").agg(F.min_by(F.struct("at", "until", "l", "x1", "y1", "x2", "y2"), "edge_no").alias("e"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("e.at") - (F.col("e.until") - F.col("e.l"))) / F.col("e.l")))
    return targets.join(first, "location_id").select(*targets.columns, (F.col("e.x1") + t * (F.col("e.x2") - F.col("e.x1"))).alias("longitude"), (F.col("e.y1") + t * (F.col("e.y2") - F.col("e.y1"))).alias("latitude"))


def proposals(segments: DataFrame, chargers: DataFrame, wanted: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(location_id, latitude, longitude, route_segment, n_chargers_proposed): the fewest stations that leave no gap along any road.

    Existing stations stand at the middle of their segment; the ends of a road count as stations. The spacing is the road's smallest."""
    segments, chargers = written(segments, "segments"), written(chargers.select("segment_id"), "chargers")
    road = F.col("Carretera_clean")
    ends = segments.groupBy(road.alias("road")).agg(F.min("PK_inicio").alias("a"), F.max("PK_fin").alias("b"), F.min("max_spacing_km").alias("spacing"))
    there = chargers.join(segments.select("segment_id", road.alias("road"), ((F.col("PK_inicio") + F.col("PK_fin")) / 2).alias("pk")), "segment_id").select("road", "pk")
    every = placement.with_road_ends(there, ends, "road", "pk", "a", "b")
    placed = None
    for km in sorted({cfg.max_spacing_km, cfg.trunk_spacing_km}):
        own = every.join(ends.filter(F.col("spacing") == km).select("road"), "road", "left_semi")
        part = placement.place_stations(placement.gap_intervals(own, "road", "pk", km), "road", km)
        placed = part if placed is None else placed.union(part)
    ident = F.sha2(F.concat_ws("|", "road", F.col("pk").cast("string")), 256)
    pts = placed.select("road", F.col("pk_proposed").alias("pk"))
    on = joins.interval_join(pts, segments.select("segment_id", road.alias("road"), "PK_inicio", "PK_fin"), ["road"], "pk", "PK_inicio", "PK_fin", 10.0)
    one = ag.distinct_first(on, ["road", "pk"], "segment_id")
    share = F.coalesce(F.try_divide(F.col("pk") - F.col("PK_inicio"), F.col("PK_fin") - F.col("PK_inicio")), F.lit(0.0))
    targets = one.select(F.concat(F.lit("LOC-"), F.substring(ident, 1, 12)).alias("location_id"), "segment_id", share.alias("share"))
    out = located(segments, targets).join(wanted.select("segment_id", "route_segment", "n_chargers_needed"), "segment_id")
    return out.select("location_id", "latitude", "longitude", "route_segment", F.col("n_chargers_needed").alias("n_chargers_proposed"))


def viability(proposed: DataFrame, grid: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Proposals with the status and distributor of the nearest substation; congested where none is near."""
    pts = proposed.select("location_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    sites = grid.select("substation_id", F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"))
    near = joins.nearest_within_km(pts, sites, cfg.substation_radius_km, "location_id", "substation_id")
    out = proposed.join(near, "location_id").join(grid.select("substation_id", "grid_status", "distributor_network"), "substation_id", "left")
    return out.withColumn("grid_status", F.coalesce("grid_status", F.lit(cfg.status_without_substation)))


def deliverables(viable: DataFrame, chargers: DataFrame, fleet: float, cfg: Config = DEFAULT, default_network: str = "i-DE") -> tuple[DataFrame, DataFrame, DataFrame]:
    """File 1, 2 and 3. A friction point without a substation near takes the default network, as the contract wants one."""
    viable, chargers = written(viable, "viable"), written(chargers, "chargers")  # the three files and their checks read these often
    f2 = viable.select(FILE_2)
    hard = viable.filter(domain.is_friction(F.col("grid_status")))
    f3 = hard.select(F.col("location_id").alias("bottleneck_id"), "latitude", "longitude", "route_segment", F.coalesce("distributor_network", F.lit(default_network)).alias("distributor_network"), domain.demand_kw(F.col("n_chargers_proposed"), cfg).alias("estimated_demand_kw"), "grid_status").select(FILE_3)
    own = viable.agg(F.count(F.lit(1)).alias("total_proposed_stations"), F.count_if(domain.is_friction(F.col("grid_status"))).alias("total_friction_points"))
    there = chargers.agg(F.count(F.lit(1)).alias("total_existing_stations_baseline"))
    f1 = own.crossJoin(there).withColumn("total_ev_projected_2027", F.lit(int(fleet)).cast("bigint")).select(FILE_1)  # one row each
    validate.require(f1, f2, f3, cfg)
    return f1, f2, f3


def run(roads: DataFrame, stations: DataFrame, sites: DataFrame, nodes: DataFrame, fleet: float, month: int, provinces: DataFrame | None = None, trunk: DataFrame | None = None, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """All stages, each a table before the next reads it: segments, chargers, coverage, demand, grid, proposals, file_1, file_2, file_3."""
    out = {"segments": written(road_segments(roads, stations, trunk, provinces, cfg), "segments")}
    out["chargers"] = written(interurban_chargers(sites, out["segments"], cfg), "chargers")
    out["coverage"] = written(segment_coverage(out["segments"], out["chargers"], cfg), "coverage")
    out["demand"] = written(demand(out["segments"], fleet, month, cfg), "demand")
    out["grid"] = written(substations(nodes, cfg), "grid")
    out["proposals"] = written(viability(written(proposals(out["segments"], out["chargers"], out["demand"], cfg), "proposed"), out["grid"], cfg), "proposals")
    out["file_1"], out["file_2"], out["file_3"] = deliverables(out["proposals"], out["chargers"], fleet, cfg)
    return out
