"""Exact quantiles by selection against sorted values."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.operators import aggregate as ag
from viaduct.operators import quantiles as qs
from viaduct.operators import window
from viaduct.plans import spatial

PROBS = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]


def shapes(rng):
    """Values of many shapes: one that nearly all have, powers, two heaps, few distinct ones, hot and tiny groups, nulls."""
    for _ in range(6000):
        yield "hot", rng.choice([7.0] * 9 + [rng.gauss(0, 1)])
    for _ in range(3000):
        yield "powers", 10.0 ** rng.uniform(-200, 200) * rng.choice([-1, 1])
        yield None, rng.choice([rng.gauss(0, 1e-9), rng.gauss(1e9, 1)])
        yield "few", float(rng.randrange(3))
    yield from (("one", 4.5), ("two", 1.0), ("two", 2.0), ("none", None), ("hot", None))


@pytest.mark.parametrize(("few", "accuracy"), [(50, 100), (700, 1000), (10**6, 10_000)])
def test_quantiles_by_group(spark, monkeypatch, few, accuracy):
    rows = list(shapes(random.Random(few)))
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    groups = defaultdict(list)
    for g, x in rows:
        if x is not None:
            groups[g].append(x)
    got = {r["g"]: (r["n"], r["q"]) for r in qs.quantiles(df, "x", PROBS, ["g"], few, accuracy).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g][0] == len(xs) and got[g][1] == pytest.approx(np.quantile(xs, PROBS).tolist(), rel=1e-12)
    every = [x for _, x in rows if x is not None]
    one = qs.quantiles(df, "x", PROBS, None, few, accuracy).collect()
    assert len(one) == 1 and one[0]["q"] == pytest.approx(np.quantile(every, PROBS).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    assert qs.quantiles(df, "x", [0.5]).count() == 0 and qs.quantiles(df, "x", [0.5], ["g"]).count() == 0
    r = ag.describe(df, "x").first()
    assert r["count"] == 0 and r["q50"] is None
    assert [x["f"] for x in window.impute_median(df, "g", "x", "f").collect()] == [None]


def test_no_more_than_few_values_are_sorted(spark, monkeypatch):
    """A tenth of the rows of one group share each value; ranges narrow to few before anything is sorted."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    seen = []
    monkeypatch.setattr(qs, "written", lambda d, what: seen.append((what, d.count())) or written(d, what))
    from viaduct.operators.store import written

    r = qs.quantiles(df, "x", [0.5], None, 30, 200).first()
    xs = [k * 7919 % 20_011 for k in range(20_000)]
    assert r["q"] == [float(np.median(xs))]
    rest = [n for what, n in seen if what == "rest"]
    assert rest and rest[0] < 4000 and all(b < a for a, b in zip(rest, rest[1:], strict=False))


def test_segments_do_not_go_through_the_driver(spark, tmp_path):
    """Of folded traffic and segments the traffic is the smaller side, whatever the size of the table that it was folded from."""
    spark.range(200_000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    k = F.col("id")
    rows = spark.range(400_000).select((k % 997).alias("l_suppkey"), (k % 50 + 1).cast("double").alias("l_quantity"), (F.rand(1) * 1e6).alias("l_extendedprice"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    df = spatial.segment_means(spark, str(tmp_path))
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert not any("p_partkey" in y for y in lines[i:end])
    assert df.count() == 200_000 and df.agg(F.sum("n_stations")).first()[0] >= 400_000
