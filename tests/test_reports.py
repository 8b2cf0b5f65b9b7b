"""Discovery and report shapes."""

import time

import pytest
from pyspark.sql import functions as F
from siltstone.operators import groups, reports
from siltstone.sources import discovery


def test_libraries_and_running(spark):
    a = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/a")], "seq int, path string")
    b = spark.createDataFrame([(1, "/c"), (2, "/b")], "seq int, path string")
    mounts = spark.createDataFrame([("/a", "btrfs", 1), ("/b", "ext4", 0), ("/c", "btrfs", 3)], "path string, fs_type string, level int")
    assert [(r.path, r.level) for r in discovery.libraries([a, b], mounts).orderBy("seq").collect()] == [("/a", 1), ("/c", 3)]
    maps = spark.createDataFrame([("7f00-7f01 r-xp 0 00:1 5 /games/Celeste/bin/x",), ("7f00 /games2/Other/y",), ("7f00 [heap]",)], "line string")
    cwd = spark.createDataFrame([("/games/Hades/run",)], "line string")
    roots = spark.createDataFrame([("/games",)], "path string")
    assert sorted(r.path for r in discovery.running_dirs(maps, cwd, roots).collect()) == ["/games/Celeste", "/games/Hades"]


def test_options_and_space(spark, tmp_path):
    o = discovery.Options.load("level=6\nmin_gain_pct=abc\nunknown=1\n# level=9\nmin_size_mib = 50")
    assert (o.level, o.min_gain_pct, o.min_size_mib) == (6, 5.0, 50) and len(o.warnings) == 2
    (tmp_path / "r.json").write_text("{}")
    assert discovery.first_readable(["/nowhere", str(tmp_path / "r.json")]) == str(tmp_path / "r.json") and discovery.first_readable(["/nowhere"]) is None
    r = discovery.capture_space(spark, str(tmp_path), "x").collect()[0]
    assert r.filesystem_space.available <= r.filesystem_space.free <= r.filesystem_space.total and r.extent_measurement.disk is None


def test_caps_and_samples(spark):
    df = spark.createDataFrame([("k", i, f"m{i}") for i in range(20)], "k string, i int, m string")
    got = reports.capped(df, ["i"], 5, "rows").collect()
    assert len(got) == 5 and (got[0].shown, got[0].total) == (5, 20)
    r = reports.error_sample(df, ["k"], "i", "m", 3).collect()[0]
    assert r.errors == 20 and r.sample == ["m0", "m1", "m2"]
    big, small = reports.dropped_small(df, "m", "i", 18)
    assert big.count() == 2 and small.collect()[0].n == 18
    assert reports.containing(df, "m", "M19").count() == 1
    assert reports.exactly_one(df, "m", "k", "m3").collect()[0].i == 3
    with pytest.raises(LookupError, match="20 matches"):
        reports.exactly_one(df, "m", "k", "k")


def test_positions(spark):
    old, new = (spark.createDataFrame([("x", a)], "k string, a array<int>") for a in ([1, 2, 3], [1, 5]))
    assert sorted((r.at, r.was, r.now) for r in reports.differing_positions(old, new, "a", "k").collect()) == [(1, 2, 5), (2, 3, None)]
    m = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "seq int, g string")
    assert reports.is_prefix(m.filter("seq < 3"), m, "seq", ["g"]) and not reports.is_prefix(m.filter("seq > 1"), m, "seq", ["g"])


def test_references(spark):
    refs = [("", 0, 1), ("archive:/other/n", 0, 1), ("archive:/own/gone", 0, 1), ("archive:/own/s", 0, 1), ("archive:/own/n", 9, 5), ("archive:/own/n", 0, 5)]
    refs = spark.createDataFrame([("p", "own", t, a, n) for t, a, n in refs], "path string, own string, target string, begin long, length long")
    nodes = spark.createDataFrame([("p", "n", 10, "resource"), ("p", "s", 10, "serialized")], "path string, name string, size long, kind string")
    assert sorted(r.status for r in reports.bundle_references(refs, nodes).collect()) == ["BOUNDS_ONLY", "INLINE", "KIND_UNSUPPORTED", "MISSING", "OUT_OF_RANGE", "UNSUPPORTED_NAMESPACE"]


def test_sequences(spark):
    packets = spark.createDataFrame([("s", f) for f in (0, 500, 1000, 1500, 3100)], "k string, frame long")
    assert [r.frame for r in reports.seek_points(packets, ["k"], "frame", F.lit(1000)).orderBy("frame").collect()] == [0, 1000, 3100]
    nodes = spark.createDataFrame([("t", i, lv) for i, lv in enumerate([0, 1, 2, 2, 1])], "k string, i int, lv int")
    assert {r.i: r.end for r in reports.subtree_ends(nodes, ["k"], "i", "lv").collect()} == {0: None, 1: 4, 2: 3, 3: 4, 4: None}
    assert [r.place for r in reports.ranked_categories(spark.createDataFrame([("a", 5.0), ("b", None)], "l string, p double"), "l", "p").orderBy("l").collect()] == [2, 1]


def test_blocks_text_and_deadlines(spark):
    files = spark.createDataFrame([("a", bytearray(b"xxxxyyyyz")), ("b", bytearray(b"yyyy")), ("c", bytearray(b""))], "f string, content binary")
    blocks = reports.file_blocks(files, "f", "content", 4)
    assert [(r.f, r.first_f, r.first_offset) for r in groups.duplicate_candidates(blocks, ["hash", "len"], "f", "offset").collect()] == [("b", "a", 4)]
    df = spark.createDataFrame([('x "res://a/b.png" res://c\n', 200)], "t string, n int")
    assert df.select(reports.resource_paths(F.col("t"))).collect()[0][0] == ["res://a/b.png", "res://c"]
    assert df.select(reports.quantise(F.col("n"), 8)).collect()[0][0] == 200 and abs(df.select(reports.quantise(F.col("n"), 5)).collect()[0][0] - 200) <= 2
    assert reports.fixed_width(df, {"n": 5, "t": 3}).collect()[0].line.startswith("  200  x")

    def work(row):
        if row["n"] == 1:
            raise ValueError("bad|row")
        time.sleep(0.3 if row["n"] == 2 else 0)
        return row["n"] * 10

    got = {r.n: (r.status, r.reason, r.value) for r in reports.with_deadline(spark.range(4).select(F.col("id").alias("n")), work, "n", 0.2).collect()}
    assert got == {0: ("ok", None, 0), 1: ("error", "bad/row", None), 2: ("timeout", "took more than 0.2 s", None), 3: ("ok", None, 30)}
    r = reports.footprint(spark.createDataFrame([("k", 10, 8)], "k string, size long, blocks long"), ["k"]).collect()[0]
    assert (r.files, r.bytes, r.allocated) == (1, 10, 4096)
