"""Members of zip archives as partitions, streamed line by line."""

import zipfile

from viaduct.sources import archives


def test_members_are_partitions(spark, tmp_path):
    want = []
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"{a}.ZIP" if a == 1 else tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("dir/", "")
            for m, lines in (("one.txt", [f"línea {k}" for k in range(20_000)]), ("dir/two.txt", ["a", "", "b"]), ("empty.txt", [])):
                z.writestr(m, "\r\n".join(lines).encode("latin-1"))
                want += [(m, k, x) for k, x in enumerate(lines)]
    (tmp_path / "other.txt").write_text("no archive")
    df = archives.zipped_lines(spark, str(tmp_path), "ISO-8859-1")
    assert df.rdd.getNumPartitions() == 9
    assert sorted((r["member"], r["number"], r["value"]) for r in df.collect()) == sorted(want)
    first = archives.zipped_lines(spark, f"file://{tmp_path}", "ISO-8859-1", first=True)
    assert {r["member"] for r in first.select("member").distinct().collect()} == {"one.txt"} and first.rdd.getNumPartitions() == 3
    alone = archives.zipped_lines(spark, str(tmp_path / "0.zip"), "ISO-8859-1").filter("member = 'dir/two.txt'")
    assert [r["value"] for r in alone.orderBy("number").collect()] == ["a", "", "b"]
    (tmp_path / "none").mkdir()
    assert archives.zipped_lines(spark, str(tmp_path / "none")).count() == 0


def test_archives_are_written_in_order_and_again(spark, tmp_path):
    rows = [(f"{k % 3}.zip", f"m{k % 2}.txt", k, f"ñ{k}" if k % 5 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "file string, member string, number long, value string").repartition(5)
    for _ in range(2):  # a second time over the same names
        archives.write_zips(df, str(tmp_path / "z"), "number", head="head")
    assert sorted(p.name for p in (tmp_path / "z").iterdir()) == ["0.zip", "1.zip", "2.zip"]
    for name in ("0.zip", "1.zip", "2.zip"):
        with zipfile.ZipFile(tmp_path / "z" / name) as z:
            assert z.testzip() is None and z.namelist() == ["m0.txt", "m1.txt"]
            for m in z.namelist():
                own = [v or "" for f, g, _, v in rows if (f, g) == (name, m)]
                assert z.read(m).decode() == "".join(f"{x}\r\n" for x in ["head", *own])
    got = archives.zipped_lines(spark, str(tmp_path / "z")).filter("number > 0").count()
    assert got == 300
