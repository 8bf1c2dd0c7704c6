"""Operators against brute force and small cases worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from viaduct.operators import aggregate as ag
from viaduct.operators import joins, placement, shapes, validate, window
from viaduct.schemas import FILE_1, FILE_2, FILE_3


def test_interval_join_takes_both_ends(spark):
    pts = spark.createDataFrame([("r", 5.0), ("r", 0.0), ("r", 11.0), ("q", 5.0), (None, 5.0)], "road string, pk double")
    seg = spark.createDataFrame([(1, "r", 0.0, 5.0), (2, "r", 5.0, 10.0), (3, "r", None, 9.0), (4, "r", 9.0, 3.0)], "id int, road string, a double, b double")
    got = joins.interval_join(pts, seg, ["road"], "pk", "a", "b", 3.0)
    assert sorted((r["pk"], r["id"]) for r in got.collect()) == [(0.0, 1), (5.0, 1), (5.0, 2)]


def edge_distance(p, e):
    (x, y), (x1, y1, x2, y2) = p, e
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / n))
    return ((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2) ** 0.5


def test_distance_joins_equal_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(120)] + [(500, 90_000.0, 0.0)]
    edges = [(i, *(rng.uniform(-300, 300) for _ in range(4))) for i in range(15)] + [(99, 5.0, 5.0, 5.0, 5.0), (7777, -300.0, -300.0, 300.0, 300.0)]
    p = spark.createDataFrame(pts, "point_id long, x double, y double")
    e = spark.createDataFrame(edges, "edge_id long, x1 double, y1 double, x2 double, y2 double")
    all_d = {i: [(edge_distance((x, y), k[1:]), k[0]) for k in edges] for i, x, y in pts}
    near = {r["point_id"] for r in joins.within_distance(p, e, 20.0).collect()}
    assert near == {i for i, v in all_d.items() if min(v)[0] < 20}
    got = {r["point_id"]: (r["edge_id"], r["dist"]) for r in joins.nearest_edge(p, e, 20.0).collect()}
    for i, v in all_d.items():
        assert got[i][1] == pytest.approx(min(v)[0])


def test_point_in_polygon_with_hole_and_overlap(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    polys = spark.createDataFrame([("1", [square(0.0, 10.0), square(4.0, 6.0)]), ("2", [square(8.0, 20.0)])], "poly_id string, rings array<array<array<double>>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.0, 9.0), (4, 15.0, 15.0), (5, 50.0, 50.0)], "point_id int, x double, y double")
    got = joins.point_in_polygon(pts, shapes.edges_of_polygons(polys, "poly_id", "rings"), 3.0)
    assert {r["point_id"]: r["poly_id"] for r in got.collect()} == {1: "1", 2: None, 3: "1", 4: "2", 5: None}


def test_centroid_is_weighted_by_length(spark):
    lines = spark.createDataFrame([(1, [[0.0, 0.0], [10.0, 0.0], [10.0, 0.0], [10.0, 2.0]])], "id int, p array<array<double>>")
    r = shapes.centroids(shapes.edges_of_lines(lines, "id", "p"), "id").first()
    assert r["x"] == pytest.approx(70 / 12) and r["y"] == pytest.approx(2 / 12)


def test_rolling_mean_of_an_even_window(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "i int, v double")
    got = {r["i"]: r["a"] for r in window.centred_average(df, "v", "a", "i").collect()}
    assert got[0] == 2.5 and got[6] == 5.5 and got[19] == 16.0
    few = window.centred_average(df.filter("i < 5"), "v", "a", "i").collect()
    assert all(r["a"] is None for r in few)


def test_imputation_order(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), ("c", 100.0), (None, None)], "g string, v double")
    got = sorted((r["g"] or "", r["f"]) for r in window.impute_median(df, "g", "v", "f").collect())
    assert got == [("", 2.5), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.5), ("c", 100.0)]


def test_placement_leaves_no_gap(spark):
    rng = random.Random(3)
    pks = [(r, rng.uniform(0, 3000)) for r in range(5) for _ in range(8)]
    st = spark.createDataFrame(pks, "road int, pk double")
    gaps = placement.gap_intervals(st, "road", "pk", 150.0)
    placed = placement.place_stations(gaps, "road", 150.0)
    every = st.union(placed.select("road", F.col("pk_proposed").alias("pk")))
    assert placement.gap_intervals(every, "road", "pk", 150.0 + 1e-6).count() == 0
    one = placement.place_stations(spark.createDataFrame([(1, 0.0, 400.0, 400.0)], "road int, gap_start double, gap_end double, gap_km double"), "road", 150.0)
    assert [round(r["pk_proposed"], 2) for r in one.orderBy("k").collect()] == [133.33, 266.67]
    mid = placement.place_stations(spark.createDataFrame([(1, 0.0, 200.0, 200.0)], "road int, gap_start double, gap_end double, gap_km double"), "road", 150.0)
    assert mid.first()["pk_proposed"] == 100.0


def test_greedy_cover(spark):
    c = spark.createDataFrame([(1, float(x)) for x in (0, 50, 100, 140, 180, 400, 500)], "road int, pk double")
    assert sorted(r["pk"] for r in placement.greedy_cover(c, "road", "pk", 150.0).collect()) == [0.0, 140.0, 180.0, 400.0, 500.0]
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), float(rng.randrange(5000))) for _ in range(900)] + [(4, 7.0), (5, None), (1, 9000.0)]
    got = sorted(tuple(r) for r in placement.greedy_cover(spark.createDataFrame(rows, "road int, pk double"), "road", "pk", 20.0).collect())
    want = []
    for road in (1, 2, 3, 4):
        left = sorted({p for r, p in rows if r == road and p is not None})
        at = left[0]
        want.append((road, at))
        while at != left[-1]:
            within = [p for p in left if at < p <= at + 20.0]
            at = within[-1] if within else min(p for p in left if p > at)
            want.append((road, at))
    assert got == want


def test_cross_tab_and_pivot(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), ("x", None)], "a string, b string")
    got = {r["a"]: (r["p"], r["q"], r["All"]) for r in ag.crosstab_margins(df, "a", "b", ["p", "q"]).collect()}
    assert got == {"x": (1, 1, 2), "y": (1, 0, 1), "All": (2, 1, 3)}
    other = df.select(ag.other_bucket(F.col("b"), ["p"]).alias("b")).collect()
    assert [r["b"] for r in other] == ["p", "Otros", "p", "Otros"]


def test_numbering_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = sorted((r["i"], r["k"]) for r in joins.numbered(df, "i", "k").collect())
    assert got == [(i, i) for i in range(1000)]


def test_first_non_null(spark):
    df = spark.createDataFrame([("k", 1, None, 5.0), ("k", 2, "b", 7.0), ("k", 3, "c", None)], "k string, o int, name string, mw double")
    r = ag.first_and_max(df, "k", ["name"], ["mw"], "o").first()
    assert (r["name"], r["mw"]) == ("b", 7.0)


def test_contract(spark):
    f1 = spark.createDataFrame([(1, 1, 1, 1)], ", ".join(f"{c} long" for c in FILE_1))
    f2 = spark.createDataFrame([("a", 1.0, 1.0, "r", 2, "Moderate"), ("b", 1.0, 1.0, "r", 2, "odd")], f"{FILE_2[0]} string, latitude double, longitude double, route_segment string, n_chargers_proposed int, grid_status string")
    f3 = spark.createDataFrame([("a", 1.0, 1.0, "r", "i-DE", 300, "Moderate"), ("b", 1.0, 1.0, "r", "nobody", 1, "Sufficient")], f"{FILE_3[0]} string, latitude double, longitude double, route_segment string, distributor_network string, estimated_demand_kw int, grid_status string")
    got = sorted(tuple(r) for r in validate.violations(f1, f2, f3).collect())
    assert [r[1] for r in got] == ["b"] * 4
    with pytest.raises(validate.ContractError):
        validate.require(f1, f2, f3)
    with pytest.raises(validate.ContractError):
        validate.columns(f1, FILE_2)
    validate.require(f1, f2.filter("location_id = 'a'"), f3.filter("bottleneck_id = 'a'"))


def test_nearest_within_km_up_to_the_poles_and_over_the_date_line(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(-89.9, 89.9) if i % 2 else rng.choice([-1, 1]) * rng.uniform(75, 90), rng.uniform(-180, 180)) for i in range(400)]
    pts += [(1000, 80.0, 0.0), (1001, 10.0, 179.99), (1002, -10.0, -179.99), (1003, 89.95, 10.0)]
    sites = [(i, max(-90.0, min(90.0, lat + rng.uniform(-0.2, 0.2))), (lon + rng.choice([0.1, 1.0, 5.0]) * rng.uniform(-1, 1) + 180) % 360 - 180) for i, lat, lon in pts[:300]]
    sites += [(2000, 80.0, 1.2), (2001, 10.0, -179.9), (2002, -10.0, 179.9), (2003, 89.95, -170.0)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 12742.0 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    want = {}
    for i, lat, lon in pts:
        near = min((km(lat, lon, b, c), j) for j, b, c in sites)
        want[i] = near[1] if near[0] <= 25 else None
    got = joins.nearest_within_km(spark.createDataFrame(pts, "point_id long, lat double, lon double"), spark.createDataFrame(sites, "site_id long, s_lat double, s_lon double"), 25.0, "point_id", "site_id").collect()
    assert {r["point_id"]: r["site_id"] for r in got} == want and None not in (want[1000], want[1001], want[1002], want[1003])
