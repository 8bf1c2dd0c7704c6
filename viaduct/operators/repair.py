"""Repair of polygons by parity: edges are noded at their crossings, what stands twice cancels, rings are traced anew.

A place is inside a polygon if a ray from it crosses the polygon's edges an odd number of times. Where edges are cut at every
crossing, a piece that stands an odd number of times separates inside from outside, and all other pieces vanish. The repaired
polygon is made of the odd pieces, each turned so that the inside lies on its left.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import walked_cells
from .store import written

#: Decimals to which places are rounded where edges are cut, so that the pieces of both edges end at the same place.
DIGITS = 9
#: Pieces of a polygon up to which its rings are traced in one row; those of larger ones meet by joins.
SMALL = 64
#: Edges for a task that looks for crossings.
EDGES = 50_000


def _sized(edges: DataFrame, ident: str) -> DataFrame:
    """edges with __size: a polygon's cells are as many in a row as the root of its edges."""
    wide = F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2")))
    sizes = edges.groupBy(ident).agg((F.when(wide > 0, wide).otherwise(1.0) / F.ceil(F.sqrt(F.count(F.lit(1))))).alias("__size"))
    return edges.join(sizes, ident)


def noded(edges: DataFrame, ident: str, digits: int = DIGITS) -> DataFrame:
    """(ident, edge, x1, y1, x2, y2): the edges (edge: a number of its own for each) cut at all places where two of one polygon cross, touch or overlap.

    Edges meet in the cells that they pass; two that meet in several cells are cut at one place more than once, which makes
    pieces without length, and those are left out."""
    parts = ceil(edges.count() / EDGES) or 1  # as edges take little room, but much time
    cells = walked_cells(_sized(edges, ident), F.col("__size")).drop("__size").repartition(parts, ident, "__cx", "__cy")
    other = {c: f"o_{c}" for c in ("edge", "x1", "y1", "x2", "y2")}
    met = cells.join(cells.withColumnsRenamed(other), [ident, "__cx", "__cy"]).filter(F.col("edge") < F.col("o_edge")).drop("__cx", "__cy")
    x, y, ox, oy = F.col("x1"), F.col("y1"), F.col("o_x1"), F.col("o_y1")
    rx, ry, sx, sy = F.col("x2") - x, F.col("y2") - y, F.col("o_x2") - ox, F.col("o_y2") - oy
    wx, wy = ox - x, oy - y
    den, off = rx * sy - ry * sx, wx * ry - wy * rx
    t, u = F.try_divide(wx * sy - wy * sx, den), F.try_divide(off, den)
    near = lambda c: c.between(-1e-12, 1 + 1e-12)
    cut = lambda edge, at, px, py: F.struct(F.col(edge).alias("edge"), at.alias("at"), px.alias("x"), py.alias("y"))
    cross_x, cross_y = x + t * rx, y + t * ry
    crossed = F.array(cut("edge", t, cross_x, cross_y), cut("o_edge", u, cross_x, cross_y))
    along, o_along = (lambda px, py: F.try_divide((px - x) * rx + (py - y) * ry, rx * rx + ry * ry)), (lambda px, py: F.try_divide((px - ox) * sx + (py - oy) * sy, sx * sx + sy * sy))
    overlaid = F.array(
        *(cut("edge", along(F.col(a), F.col(b)), F.col(a), F.col(b)) for a, b in (("o_x1", "o_y1"), ("o_x2", "o_y2"))),
        *(cut("o_edge", o_along(F.col(a), F.col(b)), F.col(a), F.col(b)) for a, b in (("x1", "y1"), ("x2", "y2"))),
    )
    cuts = met.select(ident, F.explode(F.when((den != 0) & near(t) & near(u), crossed).when((den == 0) & (off == 0), overlaid)).alias("c")).select(ident, "c.*").filter(near(F.col("at")))
    ends = edges.select(ident, F.explode(F.array(cut("edge", F.lit(0.0), x, y), cut("edge", F.lit(1.0), F.col("x2"), F.col("y2")))).alias("c")).select(ident, "c.*")
    rounded = cuts.unionByName(ends).select(ident, "edge", "at", F.round("x", digits).alias("x1"), F.round("y", digits).alias("y1"))
    w = Window.partitionBy(ident, "edge").orderBy("at", "x1", "y1")
    pieces = rounded.withColumns({"x2": F.lead("x1").over(w), "y2": F.lead("y1").over(w)})
    return pieces.filter("x2 is not null and (x1 <> x2 or y1 <> y2)").drop("at")


def _turned(pieces: DataFrame, ident: str) -> DataFrame:
    """pieces (ident, piece, x1, y1, x2, y2), which cross nowhere, each turned so that the inside lies on its left.

    A ray goes from a piece's middle to the east, or to the north if the piece lies flat; it meets pieces by bands."""
    flat = F.abs(F.col("x2") - F.col("x1")) > F.abs(F.col("y2") - F.col("y1"))
    sized = _sized(pieces, ident)
    places = lambda a, b: [F.col(f"{a}1").alias("u1"), F.col(f"{b}1").alias("v1"), F.col(f"{a}2").alias("u2"), F.col(f"{b}2").alias("v2")]
    seen = sized.select(ident, F.col("piece").alias("other"), F.lit(False).alias("flat"), "__size", *places("x", "y")).union(sized.select(ident, "piece", F.lit(True), "__size", *places("y", "x")))
    band = lambda c: F.floor(c / F.col("__size"))
    seen = seen.withColumn("band", F.explode(F.sequence(band(F.least("v1", "v2")), band(F.greatest("v1", "v2"))))).drop("__size")
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rays = sized.select(ident, "piece", flat.alias("flat"), F.when(flat, my).otherwise(mx).alias("u"), F.when(flat, mx).otherwise(my).alias("v"), "__size").withColumn("band", band(F.col("v"))).drop("__size")
    at = F.col("u1") + F.try_divide((F.col("v") - F.col("v1")) * (F.col("u2") - F.col("u1")), F.col("v2") - F.col("v1"))
    crosses = ((F.col("v1") > F.col("v")) != (F.col("v2") > F.col("v"))) & (at > F.col("u")) & (F.col("piece") != F.col("other"))
    odd = rays.join(seen, [ident, "flat", "band"]).filter(crosses).groupBy(ident, "piece").agg((F.count(F.lit(1)) % 2 == 1).alias("beyond"))
    both = pieces.join(odd, [ident, "piece"], "left").withColumn("beyond", F.coalesce("beyond", F.lit(False)))
    # inside to the north: from west to east; inside to the east: from north to south
    forward = F.when(flat, (F.col("x2") > F.col("x1")) == F.col("beyond")).otherwise((F.col("y2") < F.col("y1")) == F.col("beyond"))
    swap = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return both.select(ident, "piece", swap("x1", "x2").alias("x1"), swap("y1", "y2").alias("y1"), swap("x2", "x1").alias("x2"), swap("y2", "y1").alias("y2"))


def _followed(pieces: DataFrame, ident: str) -> DataFrame:
    """pieces with next: where a ring arrives at a place, it goes on with the first piece clockwise from where it came from."""
    back = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))
    ahead = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    none = F.lit(None).cast("bigint")
    names = ("x", "y", "angle", "piece", "leaves", "x1", "y1")
    end = lambda *values: F.struct(*(v.alias(n) for n, v in zip(names, values, strict=True)))
    start = (F.col("x1"), F.col("y1"))
    both = F.array(end(F.col("x2"), F.col("y2"), back, F.col("piece"), none, *start), end(*start, ahead, none, F.col("piece"), *start))
    w = Window.partitionBy(ident, "x", "y").orderBy(F.col("angle").desc())
    after = F.first("leaves", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    around = F.first("leaves", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = pieces.select(ident, F.explode(both).alias("e")).select(ident, "e.*").withColumn("next", F.coalesce(after, around)).filter("piece is not null")
    return out.select(ident, "piece", "next", "x1", "y1", F.col("x").alias("x2"), F.col("y").alias("y2"))


def _ringed_whole(steps: DataFrame, ident: str) -> DataFrame:
    """steps (ident, piece, next, x1, y1, x2, y2) of small polygons with ring and ahead, as _ringed has them: the same jumps, over the array of a polygon's pieces."""
    rows = steps.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("piece", "next", "x1", "y1", "x2", "y2"))).alias("p"))
    rows = rows.withColumn("all", F.transform("p", lambda q: q["piece"]))
    at = lambda jump, ring, ahead: F.struct(jump.alias("jump"), ring.alias("ring"), ahead.alias("ahead"))
    first = F.transform("p", lambda q: at((F.array_position(F.col("all"), q["next"]) - 1).cast("int"), q["piece"], F.lit(0).cast("bigint")))

    def jumped(state: Column, k: Column) -> Column:
        def one(s: Column) -> Column:
            far = F.get(state, s["jump"])
            nearer = far["ring"] < s["ring"]
            return at(far["jump"], F.least(far["ring"], s["ring"]), F.when(nearer, far["ahead"] + F.pow(F.lit(2.0), k).cast("bigint")).otherwise(s["ahead"]))

        return F.transform(state, one)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("p").cast("double"))).cast("int"))
    traced = rows.select(ident, "p", F.aggregate(rounds, first, jumped).alias("s"))
    out = traced.select(ident, F.explode(F.arrays_zip("p", "s")).alias("z"))
    return out.select(ident, *(F.col(f"z.p.{c}").alias(c) for c in ("piece", "x1", "y1", "x2", "y2")), F.col("z.s.ring").alias("ring"), F.col("z.s.ahead").alias("ahead"))


def _ringed(steps: DataFrame) -> DataFrame:
    """(piece, ring, ahead) from (piece, next): the smallest piece of each ring and the steps to it, by jumps of doubled length.

    Rounds are the logarithm of the longest ring; each is written once."""
    state = written(steps.select("piece", F.col("next").alias("jump"), F.col("piece").alias("ring"), F.lit(0).cast("bigint").alias("ahead")), "jumps")
    length = 1
    while True:
        far = state.select(F.col("piece").alias("jump"), F.col("jump").alias("__jump"), F.col("ring").alias("__ring"), F.col("ahead").alias("__ahead"))
        nearer = F.col("__ring") < F.col("ring")
        both = state.join(far, "jump").withColumn("changed", nearer)
        both = both.select("piece", F.col("__jump").alias("jump"), F.when(nearer, F.col("__ring")).otherwise(F.col("ring")).alias("ring"), F.when(nearer, F.col("__ahead") + length).otherwise(F.col("ahead")).alias("ahead"), "changed")
        both, length = written(both, "jumps"), 2 * length
        if both.filter("changed").isEmpty():
            return both.select("piece", "ring", "ahead")
        state = both.drop("changed")


def make_valid(edges: DataFrame, ident: str, digits: int = DIGITS) -> DataFrame:
    """(ident, ring, pos, x1, y1, x2, y2): polygons given by the edges of all their rings, repaired by parity.

    Rings cross neither themselves nor each other and touch at single places at most; shells run against the clock, holes with it.
    Repeated edges cancel in pairs; polygons without any inside have no row. Nulls and edges without length are left out, places are rounded to `digits`
    decimals. All work is dealt by polygon and cell, band or place, so a large polygon is worked on by many tasks; only the rings of
    one of SMALL pieces or less are traced in one row, by the same jumps."""
    own = edges.select(ident, *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).na.drop().filter("x1 <> x2 or y1 <> y2").withColumn("edge", F.monotonically_increasing_id())
    cut = noded(written(own, "edges"), ident, digits)
    swap = F.struct("x1", "y1") > F.struct("x2", "y2")
    order = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    straight = cut.select(ident, order("x1", "x2").alias("x1"), order("y1", "y2").alias("y1"), order("x2", "x1").alias("x2"), order("y2", "y1").alias("y2"))
    odd = straight.groupBy(ident, "x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").drop("n")
    pieces = written(odd.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    turned = written(_turned(pieces, ident), "turned")
    large = written(turned.groupBy(ident).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL).select(ident), "large")
    rings = _ringed_whole(_followed(turned.join(large, ident, "left_anti").repartition(ident), ident), ident)
    if not large.isEmpty():
        many = _followed(turned.join(large, ident, "left_semi"), ident)
        rings = rings.unionByName(many.drop("next").join(_ringed(many.select("piece", "next")), "piece"))
    w = Window.partitionBy(ident, "ring")
    pos = F.pmod(F.count(F.lit(1)).over(w) - F.col("ahead"), F.count(F.lit(1)).over(w))
    return rings.withColumn("pos", pos).select(ident, "ring", "pos", "x1", "y1", "x2", "y2")


def rings_of(repaired: DataFrame, ident: str) -> DataFrame:
    """(ident, rings): the repaired edges as closed rings of places, one value for each polygon, as in the files they came from."""
    path = F.sort_array(F.collect_list(F.struct("pos", "x1", "y1")))
    one = repaired.groupBy(ident, "ring").agg(path.alias("p"))
    closed = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda q: F.array(q["x1"], q["y1"]))
    return one.groupBy(ident).agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", closed.alias("path")))), lambda r: r["path"]).alias("rings"))


def area(edges: DataFrame, *by: str, name: str = "area") -> DataFrame:
    """(by..., area) of directed edges with the inside on their left."""
    return edges.groupBy(*by).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias(name))
