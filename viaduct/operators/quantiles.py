"""Exact quantiles by distributed selection: no task sorts or holds all values of a large group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Values that are sorted in one task at most; accuracy of the sketch that narrows all values down; steps of those that go on from there.
FEW, ACCURACY, STEPS = 20_000, 10_000, 100


def _joined(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of state for their keys, null keys alike; without keys, state has one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(state))
    named = state.withColumnsRenamed({k: f"__s_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys))
    return rows.join(named, on).drop(*(f"__s_{k}" for k in keys))


def _counts(lo: Column, hi: Column, name: str) -> list[Column]:
    """How many values lie below lo, up to lo, below hi and up to hi."""
    v = F.col("v")
    return [F.count_if(test).alias(f"{name}{k}") for k, test in enumerate((v < lo, v <= lo, v < hi, v <= hi))]


def _placed(rank: Column, lo: Column, hi: Column, name: str) -> Column:
    """Where the value of a rank stands: at lo, at hi (then it is known), or in one of the open ranges that they leave.

    (value, side, under): side 0 below lo, 1 between, 2 above hi; under: the values before the range."""
    below_lo, upto_lo, below_hi, upto_hi = (F.col(f"{name}{k}") for k in range(4))
    none = F.lit(None).cast("double")
    row = lambda value, side, under: F.struct(value.alias("value"), F.lit(side).alias("side"), under.cast("bigint").alias("under"))
    known = F.when(rank < below_lo, row(none, 0, F.lit(0))).when(rank < upto_lo, row(lo, 0, F.lit(0)))
    return known.when(rank < below_hi, row(none, 1, upto_lo)).when(rank < upto_hi, row(hi, 1, F.lit(0))).otherwise(row(none, 2, upto_hi))


def _inside(v: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (v > low)) & (high.isNull() | (v < high))


def _of_large(rows: DataFrame, large: DataFrame, keys: list[str], probs: list[float], few: int) -> DataFrame:
    """(keys, q) of the groups of large (keys, n, ends)."""
    lo, hi = (lambda i: F.col("ends")[2 * i]), (lambda i: F.col("ends")[2 * i + 1])
    tally = [c for i in range(len(probs)) for c in _counts(lo(i), hi(i), f"c{i}_")]
    counted = _joined(rows, large, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("ends").alias("ends"), *tally)
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    targets = []
    for i in range(len(probs)):
        for k, rank in enumerate((F.floor(at[i]), F.ceil(at[i]))):
            targets.append(F.struct(F.lit(2 * i + k).alias("i"), rank.cast("bigint").alias("rank"), lo(i).alias("lo"), hi(i).alias("hi"), _placed(rank, lo(i), hi(i), f"c{i}_").alias("x")))
    state = counted.select(*keys, F.explode(F.array(*targets)).alias("t")).select(*keys, "t.*")
    none = F.lit(None).cast("double")
    state = written(_ranges(state.withColumns({"low": none, "high": none}), [*keys, "i"]), "ranges")
    open_ = state.filter("value is null")
    asked = open_.groupBy(*keys).agg(F.collect_list(F.struct("i", "low", "high")).alias("t"))  # two entries a quantile at most
    found, own = [state.filter("value is not null").select(*keys, "i", "value")], [*keys, "i"]
    rest = _joined(rows, asked, keys).select(*keys, "v", F.explode(F.filter("t", lambda t: _inside(F.col("v"), t["low"], t["high"]))).alias("t")).select(*keys, "t.i", "v")
    while not open_.isEmpty():
        rest = written(rest, "rest")
        grid = F.percentile_approx("v", F.array(*(F.lit(k / STEPS) for k in range(STEPS + 1))), 100 * STEPS).alias("grid")
        sketch = written(_joined(rest.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), grid), open_.select(*own, "rank", "low", "high"), own), "sketch")
        w = Window.partitionBy(*own).orderBy("v")
        little = _joined(rest, sketch.filter(F.col("n") <= few).select(*own, "rank"), own).withColumn("at", F.row_number().over(w) - 1)
        found.append(little.filter(F.col("at") == F.col("rank")).select(*own, F.col("v").alias("value")))
        step = F.floor(F.col("rank") * STEPS / F.col("n")).cast("int")
        ends = {"lo": F.get("grid", F.greatest(step - 1, F.lit(0))), "hi": F.get("grid", F.least(step + 2, F.lit(STEPS)))}
        many = sketch.filter(F.col("n") > few).withColumns(ends).drop("grid", "n")
        counted = _joined(rest, many, own).groupBy(*own, "rank", "low", "high", "lo", "hi").agg(*_counts(F.col("lo"), F.col("hi"), "c"))
        state = written(_ranges(counted.withColumn("x", _placed(F.col("rank"), F.col("lo"), F.col("hi"), "c")), own), "ranges")
        found.append(state.filter("value is not null").select(*own, "value"))
        open_ = state.filter("value is null")
        rest = _joined(rest, open_.select(*own, "low", "high"), own).filter(_inside(F.col("v"), F.col("low"), F.col("high"))).select(*own, "v")
    values = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("a"))
    out = _joined(large.select(*keys, "n"), values, keys)
    low, high = (lambda i: F.col("a")[2 * i]["value"]), (lambda i: F.col("a")[2 * i + 1]["value"])
    return out.select(*keys, "n", F.array(*(low(i) + (high(i) - low(i)) * (at[i] - F.floor(at[i])) for i in range(len(probs)))).alias("q"))


def _ranges(state: DataFrame, own: list[str]) -> DataFrame:
    """state (own, rank, lo, hi, x, low, high) with the narrower open range, and the rank inside of it."""
    low = F.when(F.col("x.side") == 0, F.col("low")).when(F.col("x.side") == 1, F.col("lo")).otherwise(F.col("hi"))
    high = F.when(F.col("x.side") == 0, F.col("lo")).when(F.col("x.side") == 1, F.col("hi")).otherwise(F.col("high"))
    return state.select(*own, F.col("x.value").alias("value"), (F.col("rank") - F.col("x.under")).alias("rank"), low.alias("low"), high.alias("high"))


def quantiles(df: DataFrame, column: str, probs: list[float], by: list[str] | None = None, few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """(by..., n, q array<double>): each group's quantiles, interpolated linearly between two neighbouring ranks; exact.

    Groups of `few` values or less are computed in one task each. In a larger one, a mergeable sketch gives a range around each
    quantile; one pass over the rows counts what lies below, at and between its ends, so that it is known in which range
    a rank stands, or that it stands at an end, as the ranks of frequent values do. Only the values inside that range go on
    to the next pass, which narrows it again, until they are few. A pass leaves a few parts in `accuracy` of all values, and later
    ones a few parts in STEPS, so ranks among 10^12 values take five. Counts and sketches are combined in the tasks, before
    anything is dealt by group.

    Nulls are left out, a group without values has no row, null keys are one group."""
    keys = [f"__k{i}" for i in range(len(by or []))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by or [], keys, strict=True)), F.col(column).cast("double").alias("v")).filter("v is not null")
    ends = [min(max(p + side * 2.0 / accuracy, 0.0), 1.0) for p in probs for side in (-1, 1)]
    sketch = F.percentile_approx("v", F.array(*map(F.lit, ends)), accuracy).alias("ends")
    stats = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch).filter("n > 0"), "quantiles")
    small = _joined(rows, stats.filter(F.col("n") <= few).select(*keys, "n"), keys).groupBy(*keys).agg(F.first("n").alias("n"), F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    large = stats.filter(F.col("n") > few)
    out = small.filter("n is not null")
    if not large.isEmpty():
        out = out.unionByName(_of_large(rows, large, keys, probs, few))
    return out.select(*(F.col(k).alias(c) for c, k in zip(by or [], keys, strict=True)), "n", "q")
