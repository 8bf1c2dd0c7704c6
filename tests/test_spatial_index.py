"""The multi-level edge index and the walked cells against brute force; demand-weighted placement against the plain greedy choice."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from viaduct.operators import joins, placement

from .test_operators import edge_distance

EDGES = "edge_id long, x1 double, y1 double, x2 double, y2 double"


def edges_of(rng, n, wide, long):
    out = []
    for i in range(n):
        x, y = rng.uniform(-wide, wide), rng.uniform(-wide, wide)
        out.append((i, x, y, x + rng.uniform(-long, long), y + rng.uniform(-long, long)))
    return out


def test_walked_cells_are_those_that_an_edge_passes(spark):
    rng = random.Random(2)
    edges = edges_of(rng, 30, 50, 40) + [(90, 1.0, 1.0, 1.0, 30.0), (91, 1.0, 1.0, 30.0, 1.0), (92, 4.5, 4.5, 4.5, 4.5), (93, 0.0, 0.0, 20.0, 20.0)]
    size = 2.0
    got = defaultdict(set)
    for r in joins.walked_cells(spark.createDataFrame(edges, EDGES), size).collect():
        assert (r["__cx"], r["__cy"]) not in got[r["edge_id"]]
        got[r["edge_id"]].add((r["__cx"], r["__cy"]))
    for i, x1, y1, x2, y2 in edges:
        dense = {(math.floor((x1 + t * (x2 - x1)) / size), math.floor((y1 + t * (y2 - y1)) / size)) for t in (k / 4000 for k in range(4001))}
        assert dense <= got[i] and len(got[i]) <= 3 * len(dense)
    whole = joins.walked_cells(spark.createDataFrame([(1, 0.0, 0.0, 9000.0, 9000.0)], EDGES), 1.0).count()
    assert whole < 30_000  # the box has 81 million


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_edge_with_outliers_and_diagonals(spark, seed):
    rng = random.Random(seed)
    edges = edges_of(rng, 40, 1000, 60) + [(7000, -4000.0, -4000.0, 4000.0, 3900.0), (7001, -1000.0, 900.0, 1000.0, 900.0), (7002, -1000.0, 900.0, 1000.0, 900.0)]
    edges += [(7003, 150_000.0, 80_000.0, 150_010.0, 80_000.0), (7004, 5.0, 5.0, 5.0, 5.0)]
    pts = [(i, rng.uniform(-1200, 1200), rng.uniform(-1200, 1200)) for i in range(150)]
    pts += [(900 + k, rng.choice([-1, 1]) * 10.0 ** rng.uniform(3, 6), rng.choice([-1, 1]) * 10.0 ** rng.uniform(3, 6)) for k in range(40)]
    pts += [(990, 0.0, 900.0), (991, 149_990.0, 80_001.0), (992, 77_000.0, 40_000.0), (993, None, 1.0)]
    p, e = spark.createDataFrame(pts, "point_id long, x double, y double"), spark.createDataFrame([*edges, (8000, None, 1.0, 2.0, 3.0)], EDGES)
    got = {r["point_id"]: (r["edge_id"], r["dist"]) for r in joins.nearest_edge(p, e, 8.0).collect()}
    assert set(got) == {i for i, x, _ in pts if x is not None}
    for i, x, y in pts:
        if x is not None:
            d, k = min((edge_distance((x, y), k[1:]), k[0]) for k in edges)
            assert got[i][1] == pytest.approx(d, rel=1e-9) and (got[i][0] == k or {got[i][0], k} <= {r[0] for r in edges if edge_distance((x, y), r[1:]) <= d * (1 + 1e-12)})
    assert got[990] == (7001, 0.0)


def test_nearest_edge_of_nothing(spark):
    p, e = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, x double, y double"), spark.createDataFrame([], EDGES)
    assert joins.nearest_edge(p, e, 1.0).count() == 0
    one = spark.createDataFrame([(3, 1e6, 1e6, 1e6, 1e6)], EDGES)
    assert [tuple(r) for r in joins.nearest_edge(p, one, 1.0).collect()] == [(1, 3, pytest.approx(2**0.5 * 1e6))]
    assert joins.nearest_edge(p.limit(0), one, 1.0).count() == 0


def greedy(demand, candidates, reach, most, least):
    left, out = dict(demand), []
    while len(out) < most:
        gains = [(sum(w for d, w in left.items() if c - reach <= d <= c + reach), -c) for c in candidates]
        if not gains or max(gains)[0] < least:
            break
        g, c = max(gains)
        out.append((-c, g))
        left = {d: w for d, w in left.items() if not -c - reach <= d <= -c + reach}
    return out


@pytest.mark.parametrize("most", [3, 50])
def test_placement_by_demand_is_the_greedy_choice(spark, most):
    """Stretches far apart, repeated places, ties of gain, nulls, existing stations; other demand places other stations."""
    rng = random.Random(6)
    place = lambda: float(rng.choice([rng.randrange(0, 300), rng.randrange(900, 1100), 5000]))
    demand = [(rng.choice("abc"), place(), rng.randrange(0, 9)) for _ in range(300)] + [("a", None, 5), (None, 5.0, 5), ("b", 7.0, None)]
    sites = [(rng.choice("abcd"), place() + rng.choice([-10, 0, 15])) for _ in range(120)] + [("a", None), (None, 1.0)]
    existing = [("a", 100.0), ("b", 1000.0), ("z", 5.0), (None, 3.0)]
    run = lambda rows: placement.place_by_demand(spark.createDataFrame(rows, "road string, pk double, w long"), spark.createDataFrame(sites, "road string, pk double"), "road", "pk", "w", 20.0, most, 3, spark.createDataFrame(existing, "road string, pk double"))
    got = {(r["road"], r["step"]): (r["pk"], r["gain"]) for r in run(demand).collect()}
    want = {}
    for road in "abc":
        own = defaultdict(int)
        for r, d, w in demand:
            if r == road and d is not None and w and not any(e == r and abs(s - d) <= 20 for e, s in existing):
                own[d] += w
        chosen = greedy(own, {c for r, c in sites if r == road and c is not None}, 20.0, most, 3)
        want |= {(road, k): x for k, x in enumerate(chosen, 1)}
    assert got == want
    other = {(r["road"], r["step"]): r["pk"] for r in run([(r, d, 9 - w if w is not None else None) for r, d, w in demand]).collect()}
    assert other != {k: v[0] for k, v in got.items()}
    assert run([]).count() == 0
