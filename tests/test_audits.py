"""Audits, scans and interruptions that the driver's tables can't show."""

import time

from siltstone.operators import audits, reports
from siltstone.sources import discovery


def test_files_are_scanned(spark, tmp_path):
    (tmp_path / "g/a/b").mkdir(parents=True)
    (tmp_path / "g/.backup").mkdir()
    (tmp_path / "g/.backup/x").write_text("old")
    (tmp_path / "g/a/b/payload").write_text("12345")
    (tmp_path / "g/top").hardlink_to(tmp_path / "g/a/b/payload")
    (tmp_path / "g/link").symlink_to(tmp_path / "g/top")
    roots = spark.createDataFrame([("g", str(tmp_path / "g"))], "game string, path string")
    rows = {r.rel_path: r for r in discovery.scan_files(roots, (".backup",)).collect()}
    assert set(rows) == {"a", "a/b", "a/b/payload", "top"} and rows["top"].kind == "f" and rows["a"].kind == "d"
    assert rows["top"].ino == rows["a/b/payload"].ino and rows["top"].size == 5
    assert audits.logical_bytes(discovery.scan_files(roots).filter("kind = 'f'"), ["game"]).collect()[0].bytes == 8


def test_status_documents(spark):
    df = spark.createDataFrame([('{"games": [{"name": "A", "path": "p", "status": "UPDATED", "bytes": 5, "expected_gain": null}]}',), ("no",)], "value string")
    assert [tuple(r) for r in discovery.status_games(df).collect()] == [("A", "p", "UPDATED", 5, None)]


def test_rows_over_their_time_are_interrupted(spark):
    def work(row):
        if row["k"] == 2:
            time.sleep(30)
        if row["k"] == 3:
            raise ValueError("bad|row")
        return row["k"]

    began = time.time()
    got = {r.k: (r.status, r.value) for r in reports.with_deadline(spark.range(1, 5).withColumnRenamed("id", "k").coalesce(1), work, "k", 0.5).collect()}
    assert got == {1: ("ok", 1), 2: ("timeout", None), 3: ("error", None), 4: ("ok", 4)} and time.time() - began < 20


def test_extent_items(spark):
    rows = [("g", 1, 8192, 4096, 65536, 8192), ("g", 1, 8192, 4096, 65536, 8192), ("g", 2, 9, 9, 0, 9), ("h", 0, 10, 7, 0, 10), ("h", 0, 10, 7, 0, 10)]
    got = {r.game: (r.disk, r.raw, r.referenced, r.pct) for r in audits.extent_sizes(spark.createDataFrame(rows, "game string, kind int, raw long, disk long, physical long, referenced long"), ["game"]).collect()}
    assert got == {"g": (4096, 8192, 16384, 50), "h": (14, 20, 20, 70)}


def test_tiers_under_a_base(spark):
    rows = [("g", f"Packages{x}", x.strip("/") or "Packages", ["A.pkg"], n) for x, n in (("", 400), ("/720p", 100), ("/BC3", 100))] + [("g", f"Content/{p}", p, ["d.bin"], 5) for p in ("Windows", "Linux", "Mac")] + [("g", "Content", "Content", ["d.bin"], 5)]
    rows += [("h", p, p, ["x"], 1) for p in ("480p", "720p", "4k")] + [("i", p, p, ["x"], 1) for p in ("en", "fr")] + [("j", p, p, ["x"], 1) for p in ("720p", "BC3")]
    df = spark.createDataFrame(rows, "game string, path string, name string, members array<string>, bytes long")
    assert sorted((r.game, r.path) for r in audits.tier_plan(df, ["game"]).collect()) == [("g", "Packages/720p"), ("g", "Packages/BC3"), ("h", "480p"), ("h", "720p")]
