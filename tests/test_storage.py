"""The storage reports on a small library."""

import json

import pytest
from siltstone.plans import storage
from siltstone.sources import ledgers

MIB = 1 << 20
NS = 1_000_000_000


@pytest.fixture(scope="module")
def status(spark):
    games = [("GoodGame", "L/GoodGame"), ("BadGame", "L/BadGame"), ("New", "L/New"), ("Solo", "L/Solo"), ("Proton 9", "L/Proton 9"), ("Run", "L/Run")]
    games = spark.createDataFrame([(n, p, "L", 1, n == "Run") for n, p in games], "name string, path string, library string, level int, running boolean")
    text = "L/GoodGame|GoodGame|1000000000|50M|25M|25M|25|50|25\nL/BadGame|BadGame|1000000000|50M|49M|1M|1|50|49\nSolo|1000000000|100M|40M|60M|60|100|40"
    state = ledgers.compression_state(spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, value string"))
    files = [(p, "data/x", 50 * MIB, t * NS, "f", 1, i) for i, (p, t) in enumerate([("L/GoodGame", 2_000_000_000), ("L/BadGame", 2_000_000_000), ("L/New", 1), ("L/Solo", 5), ("L/Run", 1)])]
    files = spark.createDataFrame(files, "game string, rel_path string, size long, mtime_ns long, kind string, dev int, ino int")
    completions = spark.createDataFrame([("L/Solo", 1_500_000_000 * NS), ("L/BadGame", 2_100_000_000 * NS)], "path string, stamp_ns long")
    ratio = spark.createDataFrame([("New", "zstd1", 2.0), ("Run", "zstd6", 61.0), ("GoodGame", "zstd1", 70.0)], "game string, level string, pct double")
    out = storage.game_status(games, files, state, completions, ratio)
    return {"games": games, "state": state, "files": files, "df": out.cache()}


def test_status(status):
    got = {r.name: r for r in status["df"].collect()}
    assert set(got) == {"GoodGame", "BadGame", "New", "Solo", "Run"}
    assert {n: r.status for n, r in got.items()} == {"GoodGame": "UPDATED", "BadGame": "LOW YIELD", "New": "UNCOMPRESSED", "Solo": "COMPACTED", "Run": "RUNNING"}
    assert got["GoodGame"].expected_gain == 25 and got["New"].expected_gain is None and got["Solo"].expected_gain is None
    assert got["New"].hint_pct == 2.0 and got["New"].hint_low and got["GoodGame"].hint_pct is None and got["Run"].hint_pct is None


def test_reports(status):
    df = status["df"]
    assert {r.name: r.action for r in storage.dry_run(df).collect()} == {"GoodGame": "compress", "BadGame": "skip: low yield", "New": "compress", "Solo": "nothing", "Run": "skip: running"}
    assert sorted(r.name for r in storage.batch_queue(df).collect()) == ["GoodGame", "New"]
    assert storage.notify(df).collect()[0].message == "GoodGame, New"
    doc = json.loads(storage.status_json(df).collect()[0].value)
    assert doc["summary"]["pending"] == 2 and {g["name"]: g["expected_gain"] for g in doc["games"]}["New"] is None
    s = storage.status_summary(df).collect()[0]
    assert (s.games, s.low_yield, s.running, s.compacted) == (5, 1, 1, 1)


def test_state_reports(spark, status):
    state = status["state"]
    assert [r.name for r in storage.benchmark(state).collect()] == ["Solo", "GoodGame", "BadGame"]
    assert [r["name"] for r in storage.history(state).collect()] == ["Solo", "GoodGame", "BadGame"]
    history = ledgers.dedupe_history(spark.createDataFrame([(0, "1|g|600|1000|1000|500|1000|1000|100"), (1, "1|g|600|1000|1000|400|1000|1000|200")], "line_no int, value string"))
    s = storage.stats(state, history).collect()[0]
    assert (s["rows"], s.saved_mib, s.best_pct, s.over_half, s.dedupe_saved) == (3, 86, 60.0, 2, 200)
    exported = {r.game: r.pct for r in storage.export_ratios(state, status["games"]).collect()}
    assert exported == {"GoodGame": 50.0, "BadGame": 2.0}
    moved = {r["name"]: r.path for r in storage.migrate(state, status["games"]).collect()}
    assert moved["Solo"] == "L/Solo" and moved["GoodGame"] == "L/GoodGame"
    fresh = spark.createDataFrame([("L/GoodGame", 60, 20)], "path string, uncomp_mib long, disk_mib long")
    got = {r["name"]: (r.ts, r.saved_mib) for r in storage.recheck(state, fresh).collect()}
    assert got["GoodGame"] == (1000000000, 40) and got["BadGame"] == (1000000000, 1)
    totals = storage.dedupe_totals(spark.createDataFrame([("done", 5), ("done", None), ("skipped", None)], "status string, saved long")).collect()[0]
    assert tuple(totals) == (5, 1, 1, 0, 1)


def test_plans(spark):
    rows = [("g", f"audio/voiceover_{x}.bundle", 1) for x in ("en", "es")] + [("g", f"text/{x}/a.txt", 1) for x in ("English", "French", "German")] + [("g", "bin/x64/a.dll", 1), ("g", "bin/x86/a.dll", 1), ("g", "a.pdb", 3 * MIB), ("h", "b.pdb", 10)]
    files = spark.createDataFrame([(g, p, n, "f") for g, p, n in rows], "game string, rel_path string, size long, kind string")
    assert sorted(r.rel_path for r in storage.slim_plan(files, "en").collect()) == ["audio/voiceover_es.bundle", "text/French", "text/German"]
    assert not storage.slim_plan(files, "ja").collect() and not storage.slim_plan(files, None).collect()
    assert sorted((r.game, r.rel_path) for r in storage.prune_plan(files, ["bin/x86/a.dll"], 1).collect()) == [("g", "a.pdb"), ("g", "bin/x86/a.dll")]
    planner = spark.createDataFrame([(1, "Small", "ok", 5), (2, "Bad", "error", None), (3, "Large", "ok", 30)], "seq int, game string, status string, saving long")
    got = storage.opportunities(planner, spark.createDataFrame([("Large", 70)], "game string, saving long")).orderBy("place").collect()
    assert [(r.game, r.total) for r in got] == [("Large", 100), ("Small", 5), ("Bad", None)]
