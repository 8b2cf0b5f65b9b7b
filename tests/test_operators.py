"""Operators against direct Python on small and random tables."""

import random

from pyspark.sql import functions as F
from siltstone.operators import groups, intervals, inventory, latest, lookup, ranking, rangejoin
from siltstone.streaming import incremental


def test_interval_union_random(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(6), a, a + rng.randrange(0, 9)) for a in (rng.randrange(60) for _ in range(300))]
    got = {r.k: r for r in intervals.interval_union(spark.createDataFrame(rows, "k int, a long, b long"), ["k"], "a", "b").collect()}
    for k in range(6):
        own = sorted((a, b) for q, a, b in rows if q == k and b > a)
        covered = set().union(*(range(a, b) for a, b in own))
        islands, last = [], None
        for a, b in own:
            if last is None or a >= last:
                islands.append([])
            islands[-1].append((a, b))
            last = max(last or b, b)
        assert got[k].ranges == len(own) and got[k].union_length == len(covered) and got[k].total_length == sum(b - a for a, b in own)
        assert got[k].aliases == len(own) - len(set(own)) and got[k].overlap_groups == sum(len(set(i)) > 1 for i in islands)


def test_extent_accounting(spark):
    rows = [("f", 65536, 4096, 8192, 8192), ("f", 65536, 4096, 8192, 8192), ("f", 0, 1, 1, 1)]
    r = intervals.distinct_address_sizes(spark.createDataFrame(rows, "f string, physical long, disk long, raw long, referenced long"), ["f"], "physical", ["disk", "raw"], ["referenced"]).collect()
    assert [tuple(x) for x in r] == [("f", 4096, 8192, 16384)]


def test_range_and_asof(spark):
    rng = random.Random(7)
    ranges = [(i, s, s + rng.randrange(0, 30)) for i, s in enumerate(rng.randrange(200) for _ in range(60))]
    points = [(p,) for p in range(0, 230, 7)]
    got = rangejoin.range_join(spark.createDataFrame(points, "p long"), "p", spark.createDataFrame(ranges, "i int, s long, e long"), "s", "e", 16)
    assert sorted((r.p, r.i) for r in got.collect()) == sorted((p, i) for (p,) in points for i, s, e in ranges if s <= p < e)
    left = [(k, t) for k in range(3) for t in range(0, 40, 3)]
    right = [(k, rng.randrange(40), v) for k in range(2) for v in range(12)]
    got = rangejoin.asof_join(spark.createDataFrame(left, "k int, t long"), spark.createDataFrame(right, "k int, at long, v int"), ["k"], "t", "at", ["v"])
    want = {(k, t): max(((a, v) for q, a, v in right if q == k and a <= t), default=(None, None))[1] for k, t in left}
    assert {(r.k, r.t): r.v for r in got.collect()} == want


def test_relocate(spark):
    removed = spark.createDataFrame([(1, 10, 5), (1, 30, 10)], "f int, s long, n long")
    points = spark.createDataFrame([(1, 5), (1, 12), (1, 15), (1, 45)], "f int, p long")
    got = {r.p: (r.status, r.new_offset) for r in rangejoin.relocate(points, "p", removed, "s", "n", ["f"]).collect()}
    assert got == {5: ("MOVED", 5), 12: ("INSIDE_REMOVED", None), 15: ("MOVED", 10), 45: ("MOVED", 30)}


def test_lookups(spark):
    lines = spark.createDataFrame([("/games/a/x",), ("/games2/a",), ("/games",)], "line string")
    assert [r.line for r in lookup.prefix_matches(lines, "line", spark.createDataFrame([("/games",)], "root string"), "root").collect()] == ["/games/a/x"]
    names = spark.createDataFrame([("a.png.import",)], "n string")
    refs = spark.createDataFrame([("a.png.import", "b.stex"), ("b.stex", "c")], "s string, t string")
    assert sorted(r.path for r in lookup.one_hop(names, "n", refs, "s", "t").collect()) == ["a.png.import", "b.stex"]
    rows = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("v", 1, "c")], "k string, ts int, x string")
    assert sorted(tuple(r) for r in latest.latest_per_key(rows, ["k"], "ts").collect()) == [("u", 2, "b"), ("v", 1, "c")]


def test_files(spark):
    files = spark.createDataFrame([("g", "a/b.PNG", 10, "f", 5_000_000_000, 1, 1), ("g", "a/c.png", 10, "f", 1, 1, 1), ("g", "a", 0, "d", 9_000_000_000, 1, 2), ("h", "x.pck", 7, "f", 1, 1, 3), ("h", "x.wav", 3, "f", 1, 1, 4)], "game string, rel_path string, size long, kind string, mtime_ns long, dev int, ino int")
    marks = spark.createDataFrame([("g", 6, 9_000_000_000)], "game string, since_s long, dedupe_since_ns long")
    got = {r.game: tuple(r)[1:] for r in inventory.scan_summary(files, marks).collect()}
    assert got == {"g": (20, 2, True, False), "h": (10, 2, True, True)}
    assert inventory.once_per_inode(files.filter("kind = 'f'")).filter("game = 'g'").collect()[0].rel_path == "a/b.PNG"
    got = {r.game: tuple(r)[1:] for r in inventory.inventory(files.filter("kind = 'f'"), ["game"]).collect()}
    assert got["g"][2] == 2 and got["h"] == (2, 10, 0, 1, 7, 1, 3)
    assert {r.engine for r in inventory.engines(files, inventory.engine_rules(), ["game"]).collect()} == {"Godot"}


def test_variant_groups(spark):
    dirs = [("P", "Packages", ["A", "B"], 300), ("P", "720p", ["A", "B"], 100), ("P", "BC3", ["A", "B"], 200), ("Q", "one", ["C"], 5), ("Q", "two", ["C"], 6)]
    got = inventory.variant_groups(spark.createDataFrame(dirs, "parent string, name string, members array<string>, size long"), "parent", "name", "members", "size").collect()
    assert [(r.parent, r.reclaim, [m.path for m in r.members]) for r in got] == [("P", 300, ["Packages", "BC3", "720p"])]


def test_budget_and_cutoff(spark):
    rows = spark.createDataFrame([("k", i, c) for i, c in enumerate([5, 9, 3, 4, 2])], "k string, i int, cost long")
    assert {r.i: r.taken for r in inventory.greedy_budget(rows, ["k"], ["i"], "cost", 10).collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}
    texts = spark.createDataFrame([("k", i, "x" * 60) for i in range(6)], "k string, i int, t string")
    r = groups.cutoff_message(texts, ["k"], ["i"], "t", 180).collect()[0]
    assert r.message == ", ".join(["x" * 60] * 3) and r.more == 3


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, seq int, v int").write.parquet(source)
    for n in (1, 2):
        stream = spark.readStream.schema("k string, seq int, v int").parquet(source)
        incremental.append_ledger(stream, target, str(tmp_path / "cp"))
        incremental.upsert_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp2"), ["k"], "seq")
        if n == 1:
            spark.createDataFrame([("a", 3, 30)], "k string, seq int, v int").write.mode("append").parquet(source)
    assert {r.k: r.v for r in incremental.latest_view(spark, target, ["k"], "seq").collect()} == {"a": 30, "b": 20}
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "state" / "v1")).collect()} == {"a": 30, "b": 20}
    events = spark.createDataFrame([("a", 1)], "k string, v int").withColumn("ts", F.lit("2024-01-01 00:30:00").cast("timestamp"))
    assert incremental.event_windows(events, "ts", ["k"], "v").collect()[0].total == 1


def test_two_level_ranks(spark):
    rng = random.Random(13)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(50) if rng.random() < 0.9 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x int, i int")
    got = ranking.row_number(df, F.floor(F.col("x") / 10), [F.desc_nulls_last("x"), "i"], descending=True).collect()
    assert [(r.i) for r in sorted(got, key=lambda r: r.place)] == [i for _, _, i in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))]
    got = ranking.running(df, ["k"], F.floor(F.col("i") / 7), ["i"], F.coalesce("x", F.lit(0)), "s").collect()
    assert all(r.s == sum(x or 0 for k, x, i in rows if k == r.k and i < r.i) for r in got) and len(got) == 300
