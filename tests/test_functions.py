"""Scalar functions on fixed vectors."""

from pyspark.sql import functions as F
from siltstone.functions import text as T
from siltstone.operators import classify, quality


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).coalesce(1).select(expr).collect()]


def test_bytes_human(spark):
    sizes = [0, 512, 1023, 1024, 1536, 1048575, 1048576, 2147483648, 1099511627776, -1536]
    assert values(spark, sizes, T.bytes_human(F.col("x")), "x long") == ["0B", "512B", "1023B", "1.0K", "1.5K", "1024.0K", "1.0M", "2.0G", "1.0T", "-1.5K"]


def test_to_mib(spark):
    assert values(spark, ["10.00GiB", "512.00MiB", "1.5 GiB", "1048576", "junk"], T.to_mib(F.col("x"))) == [10240, 512, 1536, 1, None]


def test_compression_level(spark):
    rows = ["rw,compress-force=zstd,ssd", "rw,compress-force=zstd:6,ssd", "compress-force=zstd:15", "compress=zstd:1", "compress=lzo", "compress=zstd:1,compress-force=zstd:6", "compr_force=zstd:6", "compress=zstd:abc"]
    assert values(spark, rows, T.compression_level(F.col("x"))) == [3, 6, 15, 1, None, 6, None, None]
    assert values(spark, rows[3:5] + ["rw"], T.mount_class(F.col("x"))) == ["zstd", "compressed", "uncompressed"]


def test_fit_name(spark):
    rows = ["1234567890", "12345678901", "CaféSuperLongGameName", "日本語", None]
    got = values(spark, rows, T.fit_name(F.col("x"), 10))
    assert got[0] == "1234567890" and got[3] == "日本語" and got[4] is None
    assert got[1] == "123456789…" and got[2] == "CaféSupe…"


def test_percent_codec(spark):
    rows = ["/games/pipe|percent%/line\nnext", "/games/with\ttab", "%7C", "a\r"]
    assert values(spark, rows, T.percent_decode(T.percent_encode(F.col("x")))) == rows
    assert values(spark, rows, T.percent_encode(F.col("x")))[0] == "/games/pipe%7Cpercent%25/line%0Anext"
    assert values(spark, ["a%09b\tc%7C%2509"], T.display_unescape(F.col("x"))) == ["a%09b c|%09"]


def test_paths_and_names(spark):
    assert values(spark, ["/a/b//", "/", "a"], T.strip_slash(F.col("x"))) == ["/a/b", "/", "a"]
    assert values(spark, ["a/b", "../a", "/a", "a//b", "a\\b", "c:x"], T.safe_path(F.col("x"))) == [True, False, False, False, False, False]
    names = ["voice_en", "Level_Cave", "fr-voice", "Textures", "Level_en", "jp", "English(US)", "ChineseTraditional", "Finnish", "fr_FR", "es-419"]
    assert values(spark, names, T.language_of(F.col("x"))) == [None, None, "fr", None, None, None, "en", "zh", "fi", "fr", "es"]
    assert values(spark, ["voice_en", "en", "no", "a-fr_de", "main"], T.language_in(F.col("x"))) == ["en", None, None, "fr", None]
    assert values(spark, ["voice_en", "a-fr_de"], T.language_base(F.col("x"))) == ["voice", "a_de"]
    assert values(spark, ["720p", "4k", "x"], T.resolution_rank(F.col("x"))) == [720, 2160, None]
    assert values(spark, ["ui_atlas01", "ui-Atlas-01"], T.atlas_hint(F.col("x"))) == [False, True]
    assert values(spark, ["Hello, World 2!"], T.fuzzy_key(F.col("x"))) == ["helloworld2"]
    assert values(spark, ["PNG, dds ,png,"], T.normalised_list(F.col("x"))) == [["png", "dds"]]


def test_quote_hash_time(spark):
    assert values(spark, ['quote" slash\\ line\nnext'], T.json_quote(F.col("x"))) == ['"quote\\" slash\\\\ line\\nnext"']
    assert values(spark, [b"", b"a", b"foobar"], T.fnv1a64(F.col("x")), "x binary") == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    assert values(spark, [b"a|%\\\xff"], T.byte_escape(F.col("x")), "x binary") == ["a%7C%25%5C%FF"]
    assert values(spark, [1_000_000_000], T.minute(F.col("x"), 3600), "x long") == ["2001-09-09 02:46"]
    assert values(spark, ["+0130", "-0500"], T.offset_seconds(F.col("x"))) == [5400, -18000]


def test_texture_rules(spark):
    df = spark.createDataFrame([(640, 1000, 600), (1920, 4096, 2048), (3840, 4096, 2048)], "cap int, w int, h int")
    assert [r[0] for r in df.select(quality.effective_edge(F.col("w"), F.col("h"), F.col("cap"))).collect()] == [640, 2048, 3840]
    df = spark.createDataFrame([(512, 512), (4096, 64), (513, 65)], "w int, h int")
    assert [r[0] for r in df.select(quality.small_or_thin(F.col("w"), F.col("h"))).collect()] == [True, True, False]
    df = spark.createDataFrame([(8, 8, 4), (5, 3, 1)], "w int, h int, n int")
    assert [r[0] for r in df.select(quality.mip_bytes(F.col("w"), F.col("h"), 4, 8, F.col("n"))).collect()] == [32 + 8 + 8 + 8, 16]
    df = spark.createDataFrame([(100, 90, 0), (200, 100, 100), (100, 99, 1)], "before long, after long, k int")
    assert [r[0] for r in df.select(classify.efficiency(F.col("before"), F.col("after"), 50)).collect()] == ["LOW_EFFICIENCY", "CANDIDATE", "LOW_EFFICIENCY"]
    w, h = quality.scaled(F.col("w"), F.col("h"), F.lit(512), "half_up")
    assert [tuple(r) for r in spark.createDataFrame([(1024, 3), (100, 50)], "w int, h int").select(w, h).collect()] == [(512, 2), (100, 50)]
