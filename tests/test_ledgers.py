"""Ledgers, ratio documents, snapshots and jobs on small texts."""

import json

from pyspark.sql import functions as F
from siltstone.jobs import resume
from siltstone.operators import classify, ratios
from siltstone.sources import ledgers


def numbered(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, value string")


STATE = """# compression state v2
L/GoodGame|GoodGame|1000000000|50M|25M|25M|25|50|25
L/BadGame/|BadGame|1000000000|50M|49M|1M|1|50|49

Solo|1000000000|100M|40M|60M|60|100|40
TimestampOnly|1000000000
L/Marker|Marker|1000000000|0|0|0|0|0|0
L/Re%7CName|Re%7CName|100|1M|1M|0|0|1|1
L/Re%7CName|Re%7CName|50|1M|1M|0|0|2|1"""


def test_state(spark):
    rows = {r["name"]: r for r in ledgers.compression_state(numbered(spark, STATE)).collect()}
    assert rows["BadGame"].path == "L/BadGame" and rows["Re|Name"].path == "L/Re|Name" and rows["Re|Name"].uncomp_mib == 2
    assert rows["Solo"].path is None and rows["Solo"].saved_mib == 60 and rows["TimestampOnly"].ts == 1000000000
    assert {r["name"] for r in ledgers.measured(ledgers.compression_state(numbered(spark, STATE))).collect()} == {"GoodGame", "BadGame", "Re|Name"}


def test_low_yield_and_precedence(spark):
    df = spark.createDataFrame([("good", 1, False, True, 0.5, False), ("bad", None, False, True, 0.02, False), ("bad2", 1, True, True, 0.02, True), ("new", None, False, True, None, False), ("done", 1, False, False, 0.02, False)], "n string, ts long, newer boolean, pending boolean, ratio double, running boolean")
    found = df.select("n", classify.status(F.col("ts"), F.col("newer"), F.col("pending"), classify.low_yield(F.col("ratio"), 5), F.col("running")).alias("s"))
    assert dict(found.collect()) == {"good": "COMPRESSED", "bad": "LOW YIELD", "bad2": "RUNNING", "new": "UNCOMPRESSED", "done": "COMPACTED"}
    gain = df.select("n", classify.expected_gain(F.lit("UPDATED"), F.lit(50 << 20), F.col("ratio")))
    assert dict(gain.collect())["good"] == 25 and dict(gain.collect())["new"] is None


def test_libraries(spark):
    text = '"libraryfolders"\n{\n "0" { "path"\n "/home/a\\"b" }\n "1" { "path" "/mnt/c\\\\d" } "label" "path" "x"'
    assert [r.path for r in ledgers.libraries(numbered(spark, text)).orderBy("seq").collect()] == ['/home/a"b', "/mnt/c\\d", "x"]


def test_dedupe_ledgers(spark):
    rows = ledgers.dedupe_completions(numbered(spark, "5|a\n9|a\nx|b\n7|b|c\n")).collect()
    assert {r.path: r.stamp_ns for r in rows} == {"a": 9, "b|c": 7}
    rows = ledgers.dedupe_history(numbered(spark, "1|g|600|1000|1000|400|1000|1000|200\n1|g|600\nbad|g|1|1|1|1|1|1|1\n2|h|1|1|1|2|1|1|-1")).collect()
    assert [(r.path, r.saved) for r in sorted(rows, key=lambda r: r.ts)] == [("g", 200), ("h", -1)]


def test_ratios_round_trip(spark):
    doc = {"schema": 1, "games": {"Big": {"zstd1": {"pct": 72.5, "samples": 3, "min": 70, "max": 74}, "zstd6": {"pct": 61, "samples": 1, "min": 61, "max": 61}}, "No": {"zstd1": {"samples": 1}}}}
    df = spark.createDataFrame([(json.dumps(doc),), ("this is not json at all",)], "value string")
    rows = ledgers.ratios(df)
    assert sorted((r.game, r.level, r.pct) for r in rows.collect()) == [("Big", "zstd1", 72.5), ("Big", "zstd6", 61.0)]
    again = ledgers.ratios(ledgers.ratios_document(rows))
    assert sorted(again.collect()) == sorted(rows.collect())


def test_weighted_merge(spark):
    schema = "game string, level string, pct double, samples int, min double, max double"
    a = spark.createDataFrame([("MechHavoc", "zstd1", 90.0, 2, 89.9, 90.0)], schema)
    b = spark.createDataFrame([("MechHavoc", "zstd1", 80.0, 2, 79.0, 81.0), ("Brand New Game", "zstd1", 50.0, 3, 45.0, 55.0)], schema)
    rows = {r.game: r for r in ratios.weighted_merge(a, b, ["game", "level"]).collect()}
    assert tuple(rows["MechHavoc"])[2:] == (85.0, 4, 79.0, 90.0, "updated") and tuple(rows["Brand New Game"])[2:] == (50.0, 3, 45.0, 55.0, "new")


def test_records(spark):
    df = spark.createDataFrame([("a", "ASSET|4|4096"), ("b", "noise"), ("c", "ASSET|1|2"), ("c", "ASSET|1|2"), ("d", "ASSET|1")], "game string, value string")
    assert {r.game: r.status for r in ledgers.records(df, "ASSET", 3).collect()} == {"a": "ok", "b": "error", "c": "error", "d": "error"}
    df = spark.createDataFrame([("a", "ASSET_INVENTORY|4|x|1"), ("b", "ASSET_INVENTORY|4|5|1")], "game string, value string")
    assert {r.game: r.status for r in ledgers.records(df, "ASSET_INVENTORY", 4).collect()} == {"a": "error", "b": "ok"}
    plans = {"ok": "2|200|100", "grows": "2|100|200", "none": "0|200|100", "same": "0|100|100", "text": "2|200|1e2"}
    df = spark.createDataFrame([(k, f"ASSETS|plan|Balanced|{v}") for k, v in plans.items()], "game string, value string")
    got = {r.game: r.status for r in ledgers.records(df, "ASSETS", 6, texts=2, before=5).collect()}
    assert got == {"ok": "ok", "grows": "error", "none": "error", "same": "ok", "text": "error"}


def test_lines_of_several_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.vdf").write_text(f'"path"\n"/{name}1"\n"path" "/{name}2"')
    rows = ledgers.libraries(ledgers.lines(spark, str(tmp_path / "*.vdf"))).collect()
    assert sorted((r.file[-5:], r.path) for r in rows) == [("a.vdf", "/a1"), ("a.vdf", "/a2"), ("b.vdf", "/b1"), ("b.vdf", "/b2")]


def test_cut_off_lines_are_skipped(spark):
    rows = ledgers.dedupe_history(numbered(spark, "1|g|600\n1|g|600|1000|1000|400|1000|1000|200")).collect()
    assert [(r.line_no, r.saved) for r in rows] == [(1, 200)]


def snapshot(available, disk, status="available", device=1):
    m = {"status": status, "reason": None, "disk": disk, "raw": disk, "referenced": disk}
    return json.dumps({"root": "/r", "device": device, "captured_utc": "x", "filesystem_space": {"available": available, "free": 5000, "total": 9000, "fragment": 1}, "extent_measurement": m})


def test_space_delta(spark):
    def read(*docs):
        return ledgers.space_snapshots(spark.createDataFrame([(d,) for d in docs], "value string"))

    r = resume.space_delta(read(snapshot(1000, 600)), read(snapshot(1250, 400))).collect()[0]
    assert (r.available_gain, r.disk_saved) == (250, 200)
    r = resume.space_delta(read(snapshot(1000, 600)), read(snapshot(900, None, "unavailable"))).collect()[0]
    assert (r.available_gain, r.disk_saved) == (-100, None)
    assert read(snapshot(1, 0, "unavailable")).collect()[0].status == "invalid"
    assert not resume.space_delta(read(snapshot(1, 1)), read(snapshot(1, 1, device=2))).collect()


def test_jobs(spark):
    items = spark.createDataFrame([("g",)], "game string")
    records = spark.createDataFrame([("g", "compress", True, 0), ("g", "assets", True, None), ("g", "dedupe", True, 1)], "game string, stage string, started boolean, rc int")
    plan = {r.stage: r.action for r in resume.job_plan(items, records, "game", ["compress", "assets", "dedupe"], "assets").collect()}
    assert plan == {"compress": "skip", "assets": "uncertain", "dedupe": "run"}
    totals = resume.report_totals(spark.createDataFrame([("ok", 5), ("error", None), ("ok", 100)], "status string, saving long"), "saving").collect()[0]
    assert tuple(totals) == (3, 2, 1, 105)
    assert "a\\|b" in resume.markdown(spark.createDataFrame([("a|b", None)], "x string, y int"), "t")
