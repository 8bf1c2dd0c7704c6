"""Feature collections read by byte ranges against a whole parse; written parts are one document."""

import json
import random

import pytest
from pyspark.sql import functions as F

from viaduct.sources import geojson, sinks


def collection(rng, n):
    words = ['plain', 'a "quoted" one', 'brace } inside', '{"a": [1, 2}', "back\\slash", "\\\\", "é 日本 🙂", "", '"', '}"{', "line\nbreak", '"type": "Feature"']
    feats = []
    for k in range(n):
        geometry = rng.choice([{"type": "Point", "coordinates": [k / 8, -k / 4]}, {"coordinates": [k / 8, 1.5], "type": "Point"}, None])
        props = {"k": k, "text": rng.choice(words) + str(k), "more": {"deep": {"er": [{"x": "}"}, {}]}}, "none": None}
        f = {"type": "Feature", "properties": props, "geometry": geometry}
        feats.append(dict(rng.sample(list(f.items()), 3)))
    head = {"type": "FeatureCollection", "name": "a { name }", "crs": {"type": "name", "properties": {"name": "urn}"}}}
    return {**head, "features": feats, "after": {"type": "x", "n": [{}]}} if rng.random() < 0.5 else {"features": feats, **head}


@pytest.mark.parametrize(("size", "indent"), [(150, None), (700, 2), (128 << 20, None)])
def test_ranges_of_any_size(spark, tmp_path, size, indent):
    rng = random.Random(size)
    want = []
    for k in range(3):
        c = collection(rng, 60 * k)
        (tmp_path / f"{k}.json").write_text(json.dumps(c, ensure_ascii=k != 1, indent=indent))
        want += [(f["properties"]["k"], f["properties"]["text"], (f["geometry"] or {}).get("type"), (f["geometry"] or {}).get("coordinates")) for f in c["features"]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = geojson.features(spark, str(tmp_path), "array<double>", "k long, text string")
        got = [tuple(r) for r in df.collect()]
        n = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert size > 1000 or n > 20  # one file is read by many tasks


def test_written_parts_are_one_document(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.concat(F.lit('a"}{'), "id").alias("text"), F.lit(None).cast("string").alias("none"), F.array(F.col("id") / 2, F.lit(1.0)).alias("geometry"))
    out = tmp_path / "out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.geojson_collection(rows.repartition(7), str(out), "Point", "geometry", "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(out.glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and whole["type"] == "FeatureCollection"
    assert [f["properties"]["id"] for f in whole["features"]] == list(range(1000))
    assert whole["features"][3] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 1.0]}, "properties": {"id": 3, "text": 'a"}{3', "none": None}}
    back = geojson.features(spark, str(out), "array<double>", "id long, text string", parts=True)
    assert sorted((r["id"], r["text"], r["geometry"][0]) for r in back.collect()) == [(k, f'a"}}{{{k}', k / 2) for k in range(1000)]
    sinks.geojson_collection(rows.limit(0), str(tmp_path / "none"), "Point", "geometry", "id")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == {"type": "FeatureCollection", "features": []}
    assert geojson.features(spark, str(tmp_path / "none"), "array<double>", "id long", parts=True).count() == 0
