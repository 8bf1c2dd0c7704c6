"""Dissolved buffers against the area of their union by slabs, which is exact for polygons."""

import math
import random

import pytest

from viaduct.operators import buffers, repair

EDGES = "edge_id long, x1 double, y1 double, x2 double, y2 double"


def hull(points):
    points = sorted(set(points))

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def union_area(edges, radius, sides):
    """Widths of the union are linear between all heights of corners and crossings: two looks into each slab give its area."""
    polys = [hull([(x + radius * math.cos(2 * math.pi * k / sides), y + radius * math.sin(2 * math.pi * k / sides)) for x, y in ((e[1], e[2]), (e[3], e[4])) for k in range(sides)]) for e in edges]
    lines = [[(*a, *b) for a, b in zip(p, p[1:] + p[:1], strict=True)] for p in polys]
    ys = {y for p in polys for _, y in p}
    for i, own in enumerate(lines):
        for other in lines[:i]:
            for x1, y1, x2, y2 in own:
                for x3, y3, x4, y4 in other:
                    den = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
                    if abs(den) > 1e-12 and 0 <= (t := ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / den) <= 1:
                        ys.add(y1 + t * (y2 - y1))

    def width(m):
        spans = []
        for own in lines:
            xs = sorted(x1 + (m - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in own if (y1 > m) != (y2 > m))
            spans += [(xs[0], xs[-1])] if xs else []
        total, end = 0.0, -math.inf
        for a, b in sorted(spans):
            total, end = total + max(0.0, b - max(a, end)), max(end, b)
        return total

    ys = sorted(ys)
    return sum((b - a) * (width(a + (b - a) / 3) + width(b - (b - a) / 3)) / 2 for a, b in zip(ys, ys[1:], strict=False) if b - a > 1e-9)


def outline_of(spark, edges, radius, sides):
    return buffers.dissolved(spark.createDataFrame(edges, EDGES), "edge_id", radius, sides)


CHAIN = [(1, 0.0, 0.0, 10.0, 0.0), (2, 10.0, 0.0, 20.0, 5.0), (3, 20.0, 5.0, 20.0, 30.0), (4, 20.0, 30.0, 0.0, 0.0)]
RNG = random.Random(5)
SETS = {
    "one": [(1, 0.0, 0.0, 10.0, 3.0)],
    "a place": [(1, 5.0, 5.0, 5.0, 5.0)],
    "repeated and turned": [(1, 0.0, 0.0, 10.0, 3.0), (2, 0.0, 0.0, 10.0, 3.0), (3, 10.0, 3.0, 0.0, 0.0)],
    "chain with a hole": CHAIN,
    "on one line": [(1, 0.0, 0.0, 10.0, 0.0), (2, 5.0, 0.0, 15.0, 0.0), (3, 15.0, 0.0, 40.0, 0.0)],
    "inside another": [(1, 0.0, 0.0, 100.0, 0.0), (2, 50.0, 0.5, 52.0, 0.5)],
    "cross": [(1, -10.0, 0.0, 10.0, 0.0), (2, 0.0, -10.0, 0.0, 10.0)],
    "far apart": [(1, 0.0, 0.0, 1.0, 0.0), (2, 1000.0, 0.0, 1001.0, 0.0)],
    "many": [(i, *(RNG.uniform(0, 60) for _ in range(4))) for i in range(9)],
    "grid": [(i, float(RNG.randrange(6) * 5), float(RNG.randrange(6) * 5), float(RNG.randrange(6) * 5), float(RNG.randrange(6) * 5)) for i in range(9)],
}


@pytest.mark.parametrize("name", SETS)
def test_area_of_the_union(spark, name):
    edges, radius, sides = SETS[name], 3.0, 16
    out = outline_of(spark, [*edges, (99, None, 1.0, 2.0, 3.0)], radius, sides)
    assert repair.area(out).first()["area"] == pytest.approx(union_area(edges, radius, sides), rel=1e-7)
    if name == "chain with a hole":  # the outline closes: what comes to a place leaves it
        rows = [tuple(round(r[c], 6) for c in ("x1", "y1", "x2", "y2")) for r in out.collect()]
        assert sorted(r[:2] for r in rows) == sorted(r[2:] for r in rows)


def test_nothing_to_dissolve(spark):
    assert outline_of(spark, [(1, None, 1.0, 2.0, 3.0)], 3.0, 16).count() == 0


def test_sides_inside_a_crowd_are_not_clipped(spark, monkeypatch):
    """Of many buffers that lie on each other only the sides near the outline go on, and the outline stays the same."""
    rng, radius, sides, left = random.Random(8), 3.0, 16, []
    edges = [(i, x := rng.uniform(0, 6), y := rng.uniform(0, 6), x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for i in range(26)] + [(90, 40.0, 0.0, 41.0, 0.0)]

    def counted(df, what, whole=buffers.written):
        out = whole(df, what)
        left.append(out.count() if what == "sides" else math.inf)
        return out

    monkeypatch.setattr(buffers, "written", counted)
    out = outline_of(spark, edges, radius, sides)
    assert repair.area(out).first()["area"] == pytest.approx(union_area(edges, radius, sides), rel=1e-7)
    rows = [tuple(round(r[c], 6) for c in ("x1", "y1", "x2", "y2")) for r in out.collect()]
    assert sorted(r[:2] for r in rows) == sorted(r[2:] for r in rows)
    assert min(left) < len(edges) * sides / 4
