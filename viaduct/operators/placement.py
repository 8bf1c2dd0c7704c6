"""Coverage gaps along roads, the fewest stations that close them, and stations where the demand is."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import interval_join
from .store import written


def gap_intervals(stations: DataFrame, road: str, pk: str, spacing: float) -> DataFrame:
    """(road, gap_start, gap_end, gap_km) between neighbours that stand more than spacing apart."""
    own = stations.select(road, pk).distinct()
    w = Window.partitionBy(road).orderBy(pk)
    gaps = own.select(road, F.col(pk).alias("gap_start"), F.lead(pk).over(w).alias("gap_end"))
    return gaps.withColumn("gap_km", F.col("gap_end") - F.col("gap_start")).filter(F.col("gap_km") > spacing)


def with_road_ends(stations: DataFrame, roads: DataFrame, road: str, pk: str, start: str, end: str) -> DataFrame:
    """Stations, and both ends of each road as virtual ones."""
    ends = roads.select(road, F.explode(F.array(start, end)).alias(pk))
    return stations.select(road, pk).union(ends)


def place_stations(gaps: DataFrame, road: str, spacing: float) -> DataFrame:
    """Stations at equal offsets, as few as leave no gap above spacing: one alone stands in the middle."""
    n = (F.ceil(F.col("gap_km") / spacing) - 1).cast("int")
    some = gaps.withColumn("n", n).filter("n >= 1")
    placed = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return placed.select(road, "gap_start", "gap_end", "n", "k", (F.col("gap_start") + F.col("gap_km") * F.col("k") / (F.col("n") + 1)).alias("pk_proposed"))


def greedy_cover(candidates: DataFrame, road: str, pk: str, spacing: float) -> DataFrame:
    """(road, pk) of the chosen candidates: from each road's first one on, the farthest that is still within reach of the last.

    Where none is within reach, the next one is chosen. Each candidate knows its successor from a window; the path from the first one
    is marked by jumps of doubled length, so there are as many rounds as the logarithm of the longest path, and no
    road is ever one value. A round is written once. Null roads and places are left out."""
    own = candidates.select(road, F.col(pk).cast("double").alias("pk")).na.drop().distinct()
    w = Window.partitionBy(road).orderBy("pk")
    far = F.expr(f"last(pk) over (partition by `{road}` order by pk range between current row and {float(spacing)!r}D following)")
    jumps = written(own.withColumn("jump", F.when(far > F.col("pk"), far).otherwise(F.lead("pk").over(w))), "jumps")
    marked = written(jumps.groupBy(road).agg(F.min("pk").alias("pk")), "marked")
    while True:
        reached = written(marked.join(jumps, [road, "pk"]).filter("jump is not null").select(road, F.col("jump").alias("pk")), "reached")
        if reached.isEmpty():
            return marked
        marked = written(marked.union(reached), "marked")  # a path meets no place twice
        farther = jumps.select(road, F.col("pk").alias("jump"), F.col("jump").alias("__jump"))
        jumps = written(jumps.join(farther, [road, "jump"]).select(road, "pk", F.col("__jump").alias("jump")), "jumps")


def lazy_greedy(at: np.ndarray, weight: np.ndarray, candidates: np.ndarray, reach: float, most: int | None, least: int) -> list[tuple[float, int]]:
    """(candidate, gain) by falling gain: each covers the most weight within reach that none before it covers, ties to the smaller place.

    Gains only fall while others are chosen, so an old gain is an upper bound: only the candidate at the top of the heap is
    counted anew, and it is chosen if it stays on top. at and candidates ascend."""
    first, last = np.searchsorted(at, candidates - reach, "left"), np.searchsorted(at, candidates + reach, "right")
    open_ = weight.copy()  # weight that nothing covers yet
    upto = np.concatenate([[0], np.cumsum(weight)])
    heap = [(-int(g), k) for k, g in enumerate(upto[last] - upto[first]) if g >= least]
    heapq.heapify(heap)
    chosen = []
    while heap and (most is None or len(chosen) < most):
        old, k = heap[0]
        gain = int(open_[first[k] : last[k]].sum())
        if gain < least:
            heapq.heappop(heap)
        elif -old == gain:
            heapq.heappop(heap)
            chosen.append((float(candidates[k]), gain))
            open_[first[k] : last[k]] = 0
        else:
            heapq.heapreplace(heap, (-gain, k))
    return chosen


def place_by_demand(demand: DataFrame, candidates: DataFrame, road: str, pk: str, weight: str, reach: float, most: int | None = None, least: int = 1, existing: DataFrame | None = None) -> DataFrame:
    """(road, step, pk, gain): stations at the candidates of each road that cover the most demand, weighted maximum coverage by greedy choice.

    A station covers the demand within reach of it. Step 1 covers most; each further one covers the most of what is left, ties to
    the smaller pk; `most` stations a road at most, none that covers less than `least`. Demand in reach of an existing
    station is covered before. Weights are whole numbers; places without weight, and null roads, places and weights, count for nothing.

    Demand is summed by place before it is dealt. A road is cut where two places with demand lie more than two reaches apart,
    as no station covers both sides: each stretch is a group of its own, as long as its distinct places, however many rows stand
    behind them. The first `most` of a road are among the first `most` of its stretches, as gains fall from step to step."""
    folded = demand.na.drop(subset=[road, pk, weight]).groupBy(road, F.col(pk).cast("double").alias("pk")).agg(F.sum(weight).cast("bigint").alias("weight")).filter("weight > 0")
    if existing is not None:
        around = existing.na.drop(subset=[road, pk]).select(road, (F.col(pk) - reach).alias("from"), (F.col(pk) + reach).alias("to")).distinct()
        folded = folded.join(interval_join(folded, around, [road], "pk", "from", "to", 2 * reach).select(road, "pk"), [road, "pk"], "left_anti")
    w = Window.partitionBy(road).orderBy("pk")
    cut = F.coalesce(F.col("pk") - F.lag("pk").over(w) > 2 * reach, F.lit(False)).cast("int")
    stretches = folded.withColumn("cut", cut).withColumn("stretch", F.sum("cut").over(w)).drop("cut")
    ends = stretches.groupBy(road, "stretch").agg((F.min("pk") - reach).alias("from"), (F.max("pk") + reach).alias("to"))
    places = candidates.na.drop(subset=[road, pk]).select(road, F.col(pk).cast("double").alias("pk")).distinct()
    # a candidate between two stretches may reach both only at its very ends, and counts for each as far as it reaches
    own = interval_join(places, ends, [road], "pk", "from", "to", 8 * reach).select(road, "stretch", "pk", F.lit(None).cast("bigint").alias("weight"))
    kind = folded.schema[road].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pk")
        there = pdf["weight"].notna()
        d, c = pdf[there], pdf[~there]
        chosen = lazy_greedy(d["pk"].to_numpy(), d["weight"].to_numpy(np.int64), c["pk"].to_numpy(), reach, most, least)
        return pd.DataFrame({road: pdf[road].iloc[0], "pk": [p for p, _ in chosen], "gain": [g for _, g in chosen]})

    both = stretches.select(road, "stretch", "pk", "weight").unionByName(own)
    found = both.groupBy(road, "stretch").applyInPandas(choose, f"`{road}` {kind}, pk double, gain long")
    step = F.row_number().over(Window.partitionBy(road).orderBy(F.col("gain").desc(), "pk"))
    out = found.withColumn("step", step)
    return (out.filter(F.col("step") <= most) if most is not None else out).select(road, "step", "pk", "gain")
