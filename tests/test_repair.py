"""Repaired polygons against areas by parity, on bow-ties, touching, overlapping and repeated rings."""

import random
from collections import Counter, defaultdict

import pytest

from viaduct.operators import joins, repair, shapes


def parity_area(edges):
    """Sums of alternating widths over the slabs between all heights of ends and crossings."""
    ys = {y for e in edges for y in (e[1], e[3])}
    for i, (x1, y1, x2, y2) in enumerate(edges):
        for x3, y3, x4, y4 in edges[:i]:
            den = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
            if den:
                t = ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / den
                if 0 <= t <= 1:
                    ys.add(y1 + t * (y2 - y1))
    ys, total = sorted(ys), 0.0
    for a, b in zip(ys, ys[1:], strict=False):
        m = (a + b) / 2
        xs = sorted(x1 + (m - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in edges if (y1 > m) != (y2 > m))
        total += (b - a) * sum(q - p for p, q in zip(xs[::2], xs[1::2], strict=True))
    return total


def ring(*points):
    return [[float(x), float(y)] for x, y in [*points, points[0]]]


SQUARE = ring((0, 0), (10, 0), (10, 10), (0, 10))
CASES = {
    "bow-tie": ([ring((0, 0), (10, 10), (10, 0), (0, 10))], 2),
    "plain": ([SQUARE], 1),
    "clockwise": ([SQUARE[::-1]], 1),
    "hole": ([SQUARE, ring((2, 2), (4, 2), (4, 4), (2, 4))], 2),
    "overlap": ([SQUARE, ring((5, 5), (15, 5), (15, 15), (5, 15))], 2),
    "side by side": ([SQUARE, ring((10, 0), (20, 0), (20, 10), (10, 10))], 1),
    "part of a side": ([SQUARE, ring((10, 2), (20, 2), (20, 8), (10, 8))], 1),
    "touching at a place": ([SQUARE, ring((10, 10), (20, 10), (20, 20), (10, 20))], 2),
    "spike": ([ring((0, 0), (10, 0), (10, 5), (30, 5), (10, 5), (10, 10), (0, 10))], 1),
    "twice": ([SQUARE, SQUARE], 0),
    "thrice": ([SQUARE, SQUARE, SQUARE], 1),
    "star": ([ring((0, 10), (6, -8), (-9, 3), (9, 3), (-6, -8))], 5),
    "figure of eight": ([ring((0, 0), (4, 4), (8, 0), (8, 4), (4, 0), (0, 4))], None),
}


@pytest.fixture(scope="module")
def repaired(spark):
    rng = random.Random(9)
    cases = dict(CASES)
    for k in range(40):
        cases[f"random{k}"] = ([ring(*((rng.randrange(30), rng.randrange(30)) for _ in range(rng.randint(3, 9)))) for _ in range(rng.randint(1, 3))], None)
    polygons = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, rings array<array<array<double>>>")
    out = repair.make_valid(shapes.edges_of_polygons(polygons, "name", "rings"), "name")
    return cases, spark.createDataFrame(out.collect(), out.schema)


def test_area_and_rings(repaired):
    cases, out = repaired
    areas = {r["name"]: r["area"] for r in repair.area(out, "name").collect()}
    rings = {r["name"]: r["rings"] for r in repair.rings_of(out, "name").collect()}
    for name, (given, n) in cases.items():
        edges = [(*a, *b) for r in given for a, b in zip(r, r[1:], strict=False) if a != b]
        assert areas.get(name, 0.0) == pytest.approx(parity_area(edges), abs=1e-6), name
        got = rings.get(name, [])
        assert n is None or len(got) == n, name
        for r in got:
            assert r[0] == r[-1] and len(r) >= 4 and all(a != b for a, b in zip(r, r[1:], strict=False))
        back = [(*a, *b) for r in got for a, b in zip(r, r[1:], strict=False)]
        assert parity_area(back) == pytest.approx(areas.get(name, 0.0), abs=1e-6)
        assert not Counter(back) - Counter(set(back))
    assert sum(x * v - u * y for (x, y), (u, v) in zip(rings["hole"][0], rings["hole"][0][1:], strict=False)) != 0
    turns = sorted(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2 for r in rings["hole"])
    assert turns == [-4.0, 100.0]


def test_points_are_inside_as_before(spark, repaired):
    """The repaired rings hold just the places that the given ones hold by parity."""
    cases, out = repaired
    pts = spark.createDataFrame([(i, 0.013 + i % 31, 0.017 + i // 31) for i in range(31 * 31)], "point_id int, x double, y double")
    for name in ("star", "overlap", "random3", "random7"):
        given = spark.createDataFrame([(name, cases[name][0])], "name string, rings array<array<array<double>>>")
        own = joins.point_in_polygon(pts, shapes.edges_of_polygons(given, "name", "rings"), 5.0, poly_id="name")
        new = joins.point_in_polygon(pts, out.filter(out["name"] == name).select("name", "x1", "y1", "x2", "y2"), 5.0, poly_id="name")
        assert {tuple(r) for r in own.select("point_id", "name").collect()} == {tuple(r) for r in new.select("point_id", "name").collect()}


def test_nothing_to_repair(spark):
    none = spark.createDataFrame([("a", None, 1.0, 2.0, 3.0)], "name string, x1 double, y1 double, x2 double, y2 double")
    assert repair.make_valid(none, "name").count() == 0


def test_small_polygons_are_traced_without_rounds_of_joins(spark, monkeypatch):
    """One row traces what the jumps trace, rings, order and all; only polygons above the bound take rounds, each of which is written."""
    rng = random.Random(12)
    rows = []
    for i in range(40):
        path = [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(rng.choice([4, 7, 9]))]
        rows += [(i, *a, *b) for a, b in zip(path, path[1:] + path[:1], strict=True)]
    edges = spark.createDataFrame(rows, "name long, x1 double, y1 double, x2 double, y2 double")
    wrote = []

    def noted(df, what, whole=repair.written):
        wrote.append(what)
        return whole(df, what)

    monkeypatch.setattr(repair, "written", noted)
    columns = ["name", "x1", "y1", "x2", "y2"]

    def traced():
        """Each ring as its closed path from its smallest place on, as ids of pieces may differ between runs."""
        out = defaultdict(dict)
        for r in repair.make_valid(edges, "name").collect():
            out[r["name"], r["ring"]][r["pos"]] = tuple(r[c] for c in columns[1:])
        found = []
        for (name, _), ring in out.items():
            assert sorted(ring) == list(range(len(ring)))
            path = [ring[k] for k in range(len(ring))]
            assert all(a[2:] == b[:2] for a, b in zip(path, path[1:] + path[:1], strict=True))
            k = path.index(min(path))
            found.append((name, tuple(path[k:] + path[:k])))
        return sorted(found)

    small = traced()
    assert "jumps" not in wrote and len(small) > 40
    monkeypatch.setattr(repair, "SMALL", 12, raising=False)
    assert traced() == small and "jumps" in wrote
    monkeypatch.setattr(repair, "SMALL", 0, raising=False)
    assert traced() == small
