"""Buffers around edges, dissolved into one geometry: only the pieces of their outlines that no other buffer covers are left.

A buffer is the edge widened by a regular polygon of SIDES corners, so it is convex, and buffers that share an end share the
corners there. A side of one buffer is covered by another between two of its places, which the other's sides cut out. A side
meets only buffers whose edges lie near, by cells; what is covered is joined into stretches, and the rest of the side is
outline. Where two buffers have a piece of outline in common, the one with the smaller id keeps it. The union is never built
by merging shapes one into another, and no task holds it.

Where buffers are dense, nearly all sides lie deep inside the union. So cells that lie wholly inside one buffer are found first,
by the distance of their corners from an edge, and cells with many edges around that don't are cut into smaller ones. Only sides
that pass a cell which is left, and that don't lie wholly inside one buffer themselves, are clipped.
"""

from __future__ import annotations

from math import ceil, cos, pi, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .joins import walked_cells
from .store import written

SIDES = 64
#: Lengths and depths below this part of the radius are taken for rounding.
TINY = 1e-9
#: Cells in a row of one that is cut; edges around a cell from which on it is cut again.
CUT, CROWD = 4, 16
#: Rows that are sent to all tasks at most, after they were counted; edges and pairs for a task.
FEW, EDGES, PAIRS = 100_000, 2_000, 500_000


def outlines(edges: DataFrame, ident: str, radius: float, sides: int = SIDES) -> DataFrame:
    """(ident, side, x1, y1, x2, y2): the sides of each edge's buffer, against the clock.

    The corners of the polygon around the far end, as seen in each corner's direction, in order; where the direction turns from
    one end to the other, both ends have a corner."""
    angles = ((2 * pi * k / sides, pi * (2 * k - 1) / sides, pi * (2 * k + 1) / sides) for k in range(sides))
    corners = F.array(*(F.struct(*(F.lit(f(a) * (radius if not i else 1.0)).alias(f"{n}{i}") for i, a in enumerate(each) for n, f in (("x", cos), ("y", sin)))) for each in angles))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def seen(c: Column) -> Column:
        # between the outward directions of the two sides that meet in this corner
        before, after = (dx * c[f"x{i}"] + dy * c[f"y{i}"] > 0 for i in (1, 2))
        near, far = (F.array(F.col(f"x{e}") + c["x0"], F.col(f"y{e}") + c["y0"]) for e in (1, 2))
        return F.when(before & after, F.array(far)).when(~before & ~after, F.array(near)).when(before, F.array(far, near)).otherwise(F.array(near, far))

    rows = edges.select(ident, F.flatten(F.transform(corners, seen)).alias("p"))
    rows = rows.select(ident, F.concat("p", F.slice("p", 1, 1)).alias("p")).select(ident, "p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("side"))
    at = lambda step, axis: F.get(F.get(F.col("p"), F.col("side") + step), F.lit(axis))
    return rows.select(ident, "side", at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(1, 0).alias("x2"), at(1, 1).alias("y2"))


def _covered(radius: float, sides: int, earlier: Column) -> Column:
    """(from, to): the stretch of a side (x1 .. y2) inside the buffer of the edge (a1, b1, a2, b2); empty if from >= to.

    earlier: whether the other buffer keeps a common piece of outline, which then counts as inside."""
    slack = F.when(earlier, F.lit(TINY * radius)).otherwise(F.lit(-TINY * radius))
    side = lambda nx, ny, depth: F.struct(nx.alias("nx"), ny.alias("ny"), depth.alias("depth"))
    own = F.array(*(side(F.lit(cos(a)), F.lit(sin(a)), F.lit(radius * cos(pi / sides))) for a in (pi * (2 * k + 1) / sides for k in range(sides))))
    # the two sides along the edge, as deep as the polygon's corner that is next to their outward direction
    dx, dy = F.col("a2") - F.col("a1"), F.col("b2") - F.col("b1")
    length, step = F.sqrt(dx * dx + dy * dy), 2 * pi / sides
    turn = F.pmod(F.atan2(dx, -dy), F.lit(step))
    depth = radius * F.cos(F.least(turn, step - turn))
    other = F.pmod(F.atan2(-dx, dy), F.lit(step))
    other_depth = radius * F.cos(F.least(other, step - other))
    along = F.array(side(F.try_divide(-dy, length), F.try_divide(dx, length), depth), side(F.try_divide(dy, length), F.try_divide(-dx, length), other_depth))
    normals = F.when(length > 0, F.concat(own, along)).otherwise(own)
    start = F.struct(F.lit(0.0).alias("from"), F.lit(1.0).alias("to"))

    def clipped(acc: Column, n: Column) -> Column:
        reach = F.greatest(n["nx"] * F.col("a1") + n["ny"] * F.col("b1"), n["nx"] * F.col("a2") + n["ny"] * F.col("b2")) + n["depth"] + slack
        over = n["nx"] * F.col("x1") + n["ny"] * F.col("y1") - reach  # above 0: outside of this side at the start
        rise = n["nx"] * (F.col("x2") - F.col("x1")) + n["ny"] * (F.col("y2") - F.col("y1"))
        level = F.abs(rise) <= TINY * radius
        at = F.try_divide(-over, rise)
        low = F.when(level, F.when(over > 0, F.lit(2.0)).otherwise(acc["from"])).when(rise < 0, F.greatest(acc["from"], at)).otherwise(acc["from"])
        high = F.when(~level & (rise > 0), F.least(acc["to"], at)).otherwise(acc["to"])
        return F.struct(low.alias("from"), high.alias("to"))

    return F.aggregate(normals, start, clipped)


def _from_other(x: Column, y: Column) -> Column:
    """Distance of a place from the other edge (a1, b1, a2, b2)."""
    return geo.to_edge(x, y, *(F.col(c) for c in ("a1", "b1", "a2", "b2")))


def _met(rows: DataFrame, near: DataFrame, crowds: DataFrame) -> DataFrame:
    """rows (__cx, __cy) with the edges around their cells; where rows are few, the edges are not dealt by cell, so that a crowd is shared out."""
    cell = ["__cx", "__cy"]
    if rows.count() <= FEW:
        return near.join(F.broadcast(rows), cell)
    pairs = rows.join(crowds, cell).agg(F.sum("__n")).first()[0] or 0
    parts = ceil(pairs / PAIRS) or 1
    return rows.repartition(parts, *cell).join(near.repartition(parts, *cell), cell)


def _cut(rows: DataFrame) -> DataFrame:
    """rows with __u, __v: each cell (__u, __v) as the cells that it is cut into."""
    for c in ("__u", "__v"):
        rows = rows.withColumn(c, F.explode(F.sequence(F.col(c) * CUT, F.col(c) * CUT + CUT - 1)))
    return rows


def _uncovered(rows: DataFrame, size: float, depth: float) -> DataFrame:
    """Of the cells (__u, __v) with their edges, those without an edge from which all corners are within depth: (__cx, __cy, __u, __v, __n)."""
    far = F.greatest(*(_from_other((F.col("__u") + i) * size, (F.col("__v") + j) * size) for i in (0, 1) for j in (0, 1)))
    cells = rows.select("__cx", "__cy", "__u", "__v", far.alias("far")).groupBy("__cx", "__cy", "__u", "__v").agg(F.min("far").alias("far"), F.count(F.lit(1)).alias("__n"))
    return cells.filter(F.col("far") > depth).drop("far")


def _exposed(sides: DataFrame, ident: str, near: DataFrame, crowds: DataFrame, radius: float, depth: float) -> DataFrame:
    """The sides that pass a cell which isn't covered; in crowds, a small one."""
    size = radius / CUT
    whole = near.withColumns({"__u": F.col("__cx"), "__v": F.col("__cy")})
    open_ = written(_uncovered(_cut(whole), size, depth), "cells")
    crowded = written(_cut(open_.filter(F.col("__n") >= CROWD).drop("__n")), "cells")
    small = written(_uncovered(_met(crowded, near, crowds), size / CUT, depth).select(F.col("__u").alias("__cx"), F.col("__v").alias("__cy")), "cells")
    level = open_.select(F.col("__u").alias("__cx"), F.col("__v").alias("__cy"), (F.col("__n") >= CROWD).alias("__crowd"))
    columns = [ident, "side", "x1", "y1", "x2", "y2"]
    seen = walked_cells(sides, size).join(level, ["__cx", "__cy"])
    # a crowd's cells touch others: a side is asked for in small cells only if it passes no open cell without a crowd
    seen = written(seen.groupBy(*columns).agg(F.min("__crowd").alias("__crowd")), "sides")
    inner = walked_cells(seen.filter("__crowd"), size / CUT).join(small, ["__cx", "__cy"], "left_semi").select(columns).distinct()
    return seen.filter("not __crowd").select(columns).union(inner)


def dissolved(edges: DataFrame, ident: str, radius: float, sides: int = SIDES) -> DataFrame:
    """(ident, side, x1, y1, x2, y2): the outline of the union of the buffers of all edges (ident, x1, y1, x2, y2), the inside on the left.

    ident names an edge once; of edges with the same ends only the smallest ident has a buffer. Edges without length give
    a polygon around their place. Rows with nulls are left out."""
    own = edges.select(ident, *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).na.drop()
    swap = F.struct("x1", "y1") > F.struct("x2", "y2")
    order = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    ends = [order(a, b).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"))] + [order(b, a).alias(b) for a, b in (("x1", "x2"), ("y1", "y2"))]
    own = written(own.select(ident, *ends).groupBy("x1", "y1", "x2", "y2").agg(F.min(ident).alias(ident)), "edges")
    n = own.count()
    dealt = own.repartition(max(ceil(n / EDGES), min(ceil(n / 32), 64), 1))
    near = walked_cells(dealt, radius, 1).select(F.col(ident).alias("__other"), F.col("x1").alias("a1"), F.col("y1").alias("b1"), F.col("x2").alias("a2"), F.col("y2").alias("b2"), "__cx", "__cy")
    crowds = written(near.groupBy("__cx", "__cy").agg(F.count(F.lit(1)).alias("__n")), "crowds")
    depth = radius * cos(pi / sides) * (1 - 1e-6)
    parts = written(_exposed(outlines(dealt, ident, radius, sides), ident, near, crowds, radius, depth), "sides")
    passed = written(walked_cells(parts, radius), "sides")
    met = _met(passed, near, crowds).filter(F.col(ident) != F.col("__other"))
    # a side whose two ends lie inside one buffer is inside as a whole
    ends = F.greatest(_from_other(F.col("x1"), F.col("y1")), _from_other(F.col("x2"), F.col("y2")))
    buried = met.select(ident, "side", ends.alias("d")).groupBy(ident, "side").agg(F.min("d").alias("d")).filter(F.col("d") <= depth)
    parts = written(parts.join(buried, [ident, "side"], "left_anti"), "sides")
    passed = written(walked_cells(parts, radius), "sides")
    half = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1"))) / 2
    reached = _from_other((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2) <= (radius + half) * (1 + 1e-6)
    met = _met(passed, near, crowds).filter(F.col(ident) != F.col("__other")).filter(reached)
    inside = met.select(ident, "side", _covered(radius, sides, F.col("__other") < F.col(ident)).alias("c")).select(ident, "side", "c.*").filter(F.col("to") > F.col("from"))
    # what is left of a side: from the end of all stretches so far to the start of the next one
    limits = inside.unionByName(parts.select(ident, "side", F.lit(1.0).alias("from"), F.lit(1.0).alias("to")))
    before = Window.partitionBy(ident, "side").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    gaps = limits.select(ident, "side", F.coalesce(F.max("to").over(before), F.lit(0.0)).alias("t1"), F.col("from").alias("t2")).filter(F.col("t2") - F.col("t1") > TINY)
    out = parts.join(gaps, [ident, "side"])
    at = lambda t, a: F.col(f"{a}1") + F.col(t) * (F.col(f"{a}2") - F.col(f"{a}1"))
    return out.select(ident, "side", at("t1", "x").alias("x1"), at("t1", "y").alias("y1"), at("t2", "x").alias("x2"), at("t2", "y").alias("y2"))
