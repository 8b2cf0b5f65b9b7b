"""Queries over the driver's tables, one for each relational operator, beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, groups, intervals, inventory, latest, lookup, quality, ranking, rangejoin, ratios
from ..sources import headers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Dates as whole days, on both sides.
CENTS = "CAST(floor({0} * 100 + 0.5) AS BIGINT)"


def query(sql: str | None = None):
    """Register a function (t) -> DataFrame, where t(name) reads a table, under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _disk(price="l_extendedprice", discount="l_discount"):
    return ratios.cents(F.col(price) * (1 - F.col(discount)))


def _board(t) -> DataFrame:
    lines = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return ratios.leaderboard(lines, "p_brand", ratios.cents(F.col("l_extendedprice")), _disk())


_BOARD = f"""
SELECT p_brand, before, after, before - after AS saved, ((before - after) * 10000) // before AS saved_bp FROM (
  SELECT p_brand, CAST(sum({CENTS.format('l_extendedprice')}) AS BIGINT) AS before, CAST(sum({CENTS.format('l_extendedprice * (1 - l_discount)')}) AS BIGINT) AS after
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand) WHERE before > 0"""


@query(f"SELECT *, row_number() OVER (ORDER BY saved_bp DESC, p_brand DESC) AS place FROM ({_BOARD})")
def ratio_leaderboard(t):
    return _board(t).withColumn("place", F.row_number().over(Window.orderBy(F.desc("saved_bp"), F.desc("p_brand"))))


@query(f"""SELECT count(*) AS n_keys, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after, CAST(sum(saved) AS BIGINT) AS saved,
 count(*) FILTER (WHERE saved_bp >= 500) AS n_over, (SELECT p_brand FROM ({_BOARD}) WHERE saved_bp > 0 ORDER BY saved_bp DESC, p_brand LIMIT 1) AS best_key,
 (SELECT max(saved_bp) FROM ({_BOARD}) WHERE saved_bp > 0) AS best_bp FROM ({_BOARD})""")
def ratio_summary(t):
    return ratios.summary(_board(t), "p_brand", 500)


_LATEST = "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(_LATEST)
def latest_per_key(t):
    return latest.latest_per_key(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id")


@query(f"SELECT event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT user_id, event_type, {CENTS.format('value')} AS v FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) GROUP BY event_type")
def latest_sum_by_key(t):
    rows = t("events").select("user_id", "event_type", "ts", "event_id", ratios.cents(F.col("value")).alias("v"))
    return latest.latest_per_key(rows, ["user_id", "event_type"], "ts", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_write_wins(t):
    return latest.last_write_wins(t("events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], "event_id")


@query("SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL")
def max_stamp_per_key(t):
    return latest.max_stamp_per_key(t("events"), ["user_id", "event_type"], "ts")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'purchase'")
def history_newest_first(t):
    own = t("events").filter("event_type = 'purchase'")
    ranked = ranking.row_number(own, F.to_date("ts"), [F.desc("ts"), F.desc("event_id")], descending=True)
    return ranked.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), "place")


@query(f"""SELECT o_orderkey, o_orderstatus, local, CASE WHEN local IS NULL AND o_orderstatus IN ('O', 'P') THEN h.hint END AS hint FROM (
  SELECT o_orderkey, o_orderstatus, o_custkey, c_nationkey, c_mktsegment, CASE WHEN o_orderkey % 3 = 0 THEN {CENTS.format('o_totalprice')} END AS local FROM orders JOIN customer ON o_custkey = c_custkey)
  LEFT JOIN (SELECT c_nationkey, c_mktsegment, max({CENTS.format('c_acctbal')}) AS hint FROM customer GROUP BY ALL) h USING (c_nationkey, c_mktsegment)""")
def keyed_hint_join(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("local", F.when(F.col("o_orderkey") % 3 == 0, ratios.cents(F.col("o_totalprice"))))
    hints = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max(ratios.cents(F.col("c_acctbal"))).alias("value"))
    return lookup.hint_join(rows, hints, ["c_nationkey", "c_mktsegment"], "local", "value", F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus", "local", "hint")


@query("""SELECT c_custkey, coalesce(n.stamp, r.stamp, 0) AS stamp FROM (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
  LEFT JOIN (SELECT s_nationkey AS c_nationkey, max(s_suppkey) AS stamp FROM supplier WHERE s_acctbal < 0 GROUP BY 1) n USING (c_nationkey)
  LEFT JOIN (SELECT r_regionkey AS n_regionkey, CAST(1000 + r_regionkey AS BIGINT) AS stamp FROM region WHERE r_regionkey < 4) r USING (n_regionkey)""")
def two_level_coalesce(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    near = t("supplier").filter("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_suppkey").alias("stamp"))
    far = t("region").filter("r_regionkey < 4").select(F.col("r_regionkey").alias("n_regionkey"), (F.col("r_regionkey") + 1000).cast("long").alias("stamp"))
    return lookup.two_level(rows, near, "c_nationkey", far, "n_regionkey", "stamp", 0, "out").select("c_custkey", F.col("out").alias("stamp"))


@query("""SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  UNION ALL SELECT DISTINCT o_custkey, 'updated', CAST(-1 AS INTEGER) FROM orders WHERE o_orderstatus = 'P'""")
def anti_upsert(t):
    fresh = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit("updated").alias("c_name"), F.lit(-1).alias("c_nationkey")).distinct()
    return lookup.upsert(t("customer").select("c_custkey", "c_name", "c_nationkey"), fresh, "c_custkey")


_HALF = "SELECT event_type, user_id % 20 AS bucket, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) / count(*) AS pct, count(*) AS samples, CAST(min(floor(value)) AS DOUBLE) AS lo, CAST(max(floor(value)) AS DOUBLE) AS hi FROM events WHERE {} GROUP BY ALL"


@query(f"""SELECT event_type, bucket, CASE WHEN a.pct IS NULL THEN b.pct WHEN b.pct IS NULL THEN a.pct ELSE (a.pct * a.samples + b.pct * b.samples) / (a.samples + b.samples) END AS pct,
  coalesce(a.samples, 0) + coalesce(b.samples, 0) AS samples, least(a.lo, b.lo) AS min, greatest(a.hi, b.hi) AS max, CASE WHEN a.pct IS NULL THEN 'new' WHEN b.pct IS NULL THEN 'kept' ELSE 'updated' END AS status
  FROM ({_HALF.format('event_id % 2 = 0 AND user_id % 20 < 15')}) a FULL JOIN ({_HALF.format('event_id % 2 = 1 AND user_id % 20 > 4')}) b USING (event_type, bucket)""")
def full_outer_weighted_merge(t):
    def half(keep):
        v = F.floor("value")
        return t("events").filter(keep).groupBy("event_type", (F.col("user_id") % 20).alias("bucket")).agg((F.sum(v).cast("double") / F.count("*")).alias("pct"), F.count("*").alias("samples"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))

    return ratios.weighted_merge(half("event_id % 2 = 0 and user_id % 20 < 15"), half("event_id % 2 = 1 and user_id % 20 > 4"), ["event_type", "bucket"], None)


@query(f"SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(sum({CENTS.format('c_acctbal')}) AS BIGINT) AS total, min({CENTS.format('c_acctbal')}) AS least, max({CENTS.format('c_acctbal')}) AS most FROM customer GROUP BY ALL")
def sorted_group_stats(t):
    return ratios.grouped_stats(t("customer"), ["c_mktsegment", "c_nationkey"], ratios.cents(F.col("c_acctbal")))


_STATUS = """SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'RUNNING' WHEN shipped IS NULL OR o_orderdate > shipped THEN CASE WHEN coalesce(o_totalprice < 20000, false) THEN 'LOW YIELD' WHEN shipped IS NULL THEN 'UNCOMPRESSED' ELSE 'UPDATED' END
  WHEN n_lines > 4 THEN 'COMPRESSED' ELSE 'COMPACTED' END AS status, coalesce(n_lines > 4, false) AS dedupe_pending
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""


def _statuses(t) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"), F.count("*").alias("n_lines"))
    rows = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("dedupe_pending", F.coalesce(F.col("n_lines") > 4, F.lit(False)))
    found = classify.status(F.col("shipped"), F.col("o_orderdate") > F.col("shipped"), F.col("dedupe_pending"), F.col("o_totalprice") < 20000, F.col("o_custkey") % 11 == 0)
    return rows.select("o_orderkey", found.alias("status"), "dedupe_pending")


@query(_STATUS)
def status_precedence(t):
    return _statuses(t)


@query(f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY status")
def status_counts(t):
    return _statuses(t).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT * FROM ({_STATUS}) WHERE status IN ('COMPRESSED', 'UPDATED', 'UNCOMPRESSED') OR (status = 'LOW YIELD' AND dedupe_pending)")
def pending_only(t):
    return _statuses(t).filter(classify.is_pending(F.col("status"), F.col("dedupe_pending")))


@query("""SELECT user_id, last_seen, n_rows, mark FROM (SELECT user_id, max(ts) AS last_seen, count(*) AS n_rows FROM events GROUP BY 1)
  LEFT JOIN (SELECT user_id, max(ts) AS mark FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (user_id) WHERE mark IS NULL OR last_seen > mark""")
def changed_since_mark(t):
    marks = t("events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("mark"))
    return classify.changed_since(t("events"), marks, "user_id", "ts", "mark")


@query("""SELECT source, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) FILTER (WHERE n_chars >= 4096) AS packed,
  CAST(coalesce(sum(n_chars) FILTER (WHERE n_chars >= 4096), 0) AS BIGINT) AS packed_bytes FROM documents GROUP BY ALL""")
def conditional_inventory(t):
    big = F.col("n_chars") >= 4096
    return t("documents").groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.count_if(big).alias("packed"), F.coalesce(F.sum(F.when(big, F.col("n_chars"))), F.lit(0)).alias("packed_bytes"))


@query("SELECT p_type, p_size % 5 AS class, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS bytes, min(p_name) AS example FROM part GROUP BY ALL")
def class_rollup_example(t):
    return inventory.rollup_example(t("part").withColumn("class", F.col("p_size") % 5), ["p_type", "class"], F.col("p_size"), "p_name")


@query(f"""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(sum({CENTS.format('l_extendedprice')}) AS BIGINT) AS total, max(l_quantity) AS most, count(*) FILTER (WHERE l_discount > 0.05) AS loops
  FROM lineitem GROUP BY ALL""")
def multi_key_media_rollup(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.sum(ratios.cents(F.col("l_extendedprice"))).alias("total"), F.max("l_quantity").alias("most"), F.count_if(F.col("l_discount") > 0.05).alias("loops"))


_BLOCKS = "SELECT doc_id, CAST(b * 64 AS BIGINT) AS \"offset\", md5(substr(text, CAST(b * 64 + 1 AS BIGINT), 64)) AS hash FROM documents, unnest(range(0, length(text) // 64)) AS u(b)"


def _blocks(t) -> DataFrame:
    return groups.text_blocks(t("documents"), "doc_id", "text", 64).select("doc_id", "offset", F.md5("content").alias("hash"))


@query(f"""SELECT doc_id, "offset", hash, first_doc_id, first_offset FROM (SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value("offset") OVER w AS first_offset, row_number() OVER w AS k FROM ({_BLOCKS})
  WINDOW w AS (PARTITION BY hash ORDER BY doc_id, "offset")) WHERE k > 1""")
def block_dup_candidates(t):
    return groups.duplicate_candidates(_blocks(t), ["hash"], "doc_id", "offset")


@query(f"SELECT count(*) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS candidates, CAST(sum((n - 1) * 64) AS BIGINT) AS matched FROM (SELECT hash, count(*) AS n FROM ({_BLOCKS}) GROUP BY hash) WHERE n > 1")
def block_dup_totals(t):
    return groups.duplicate_totals(_blocks(t), ["hash"], F.lit(64))


@query("SELECT md5(text) AS hash, length(text) AS len, min(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_dup_groups(t):
    return groups.copies(t("documents"), "doc_id", [F.md5("text"), F.char_length("text").cast("long")], ["hash", "len"])


@query(f"""SELECT l_returnflag, CAST(sum(price) AS BIGINT) AS price, CAST(sum(referenced) AS BIGINT) AS referenced FROM (SELECT l_returnflag, l_partkey, min({CENTS.format('p_retailprice')}) AS price, sum(CAST(l_quantity AS BIGINT)) AS referenced
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey <> 0 GROUP BY ALL) GROUP BY ALL""")
def distinct_address_sizes(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_returnflag", "l_partkey", ratios.cents(F.col("p_retailprice")).alias("price"), F.col("l_quantity").cast("long").alias("referenced"))
    return intervals.distinct_address_sizes(rows, ["l_returnflag"], "l_partkey", ["price"], ["referenced"])


_CLIP = "greatest(0, least(CAST(l_quantity AS BIGINT) * 10, 300 - CAST(l_linenumber AS BIGINT) * 40))"


@query(f"SELECT l_orderkey, CAST(sum({_CLIP}) AS BIGINT) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE {_CLIP} END) AS BIGINT) AS exclusive, CAST(sum(CASE WHEN l_returnflag = 'R' THEN {_CLIP} ELSE 0 END) AS BIGINT) AS shared FROM lineitem GROUP BY 1")
def clipped_split_usage(t):
    return intervals.clipped_usage(t("lineitem"), ["l_orderkey"], F.col("l_quantity").cast("long") * 10, 300 - F.col("l_linenumber").cast("long") * 40, F.col("l_returnflag") == "R")


_RANGES = "SELECT l_suppkey, least(o, s) AS a, greatest(o, s) AS b FROM (SELECT l_suppkey, epoch_ms(o_orderdate) // 86400000 AS o, epoch_ms(l_shipdate) // 86400000 AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _ranges(t) -> DataFrame:
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return rows.select("l_suppkey", F.least(day("o_orderdate"), day("l_shipdate")).alias("a"), F.greatest(day("o_orderdate"), day("l_shipdate")).alias("b"))


@query(f"""WITH e AS (SELECT l_suppkey, a, b, count(*) AS copies FROM ({_RANGES}) WHERE b > a GROUP BY ALL),
 m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
 n AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach <= a THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
 i AS (SELECT l_suppkey, island, max(b) - min(a) AS covered, count(*) AS kinds, sum(copies) AS copies, sum((b - a) * copies) AS length FROM n GROUP BY ALL)
 SELECT l_suppkey, CAST(sum(copies) AS BIGINT) AS ranges, CAST(sum(length) AS BIGINT) AS total_length, CAST(sum(covered) AS BIGINT) AS union_length, CAST(sum(copies - kinds) AS BIGINT) AS aliases, count(*) FILTER (WHERE kinds > 1) AS overlap_groups FROM i GROUP BY 1""")
def interval_union(t):
    return intervals.interval_union(_ranges(t), ["l_suppkey"], "a", "b")


@query(f"SELECT l_suppkey, a, b, coalesce(lag(b) OVER (PARTITION BY l_suppkey ORDER BY a, b) > a, false) AS overlaps FROM (SELECT DISTINCT * FROM ({_RANGES})) WHERE b > a")
def overlap_pairs(t):
    return intervals.overlap_flags(_ranges(t).distinct(), ["l_suppkey"], "a", "b")


_CHUNKS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, size, coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM (SELECT *, CAST(l_quantity AS BIGINT) * 7 AS size FROM lineitem)"""
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"SELECT l_orderkey, blk AS block, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT *, unnest(range(CAST(pos // 64 AS BIGINT), CAST((pos + size - 1) // 64 + 1 AS BIGINT))) AS blk FROM ({_CHUNKS}) WHERE size > 0) GROUP BY ALL")
def chunk_to_block(t):
    rows = t("lineitem").withColumn("size", F.col("l_quantity").cast("long") * 7)
    placed = rangejoin.running(rows, ["l_orderkey"], _LINE, F.col("size"), "pos")
    return rangejoin.chunk_blocks(placed, "pos", "size", 64).groupBy("l_orderkey", "block").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))


@query("""SELECT a.user_id, a.event_id, b.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_prefix(t):
    left = t("events").filter("event_type <> 'purchase'").select("user_id", "event_id", "ts")
    right = t("events").filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase_id"))
    return rangejoin.asof_join(left, right, ["user_id"], "ts", "at", ["purchase_id"]).select("user_id", "event_id", "purchase_id")


@query("""SELECT l_orderkey, count(*) AS n, CAST(max(shorts) AS BIGINT) AS shorts, bool_and(shorts = 0) AS complete FROM (SELECT l_orderkey, sum(CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS shorts FROM lineitem) GROUP BY 1""")
def prefix_completeness(t):
    marked = rangejoin.running(t("lineitem"), ["l_orderkey"], _LINE, F.when(F.col("l_quantity") < 5, 1).otherwise(0), "shorts", inclusive=True)
    return marked.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("shorts").alias("shorts"), F.bool_and(F.col("shorts") == 0).alias("complete"))


@query("""SELECT doc_id, source, CAST(64 + coalesce(sum(((n_chars + 31) // 32) * 32) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM documents""")
def aligned_layout(t):
    step = rangejoin.align_up(F.col("n_chars"), 32)
    return ranking.running(t("documents"), ["source"], F.floor(F.col("doc_id") / 4096), ["doc_id"], step, "pos").select("doc_id", "source", (F.col("pos") + 64).alias("pos"))


@query("SELECT array_to_string(members, ',') AS members, count(*) AS n, min(l_orderkey) AS least_parent FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS members FROM lineitem GROUP BY 1) GROUP BY ALL HAVING count(*) > 1")
def set_equality_groups(t):
    return groups.set_equality(t("lineitem"), "l_orderkey", "l_partkey").withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("SELECT * FROM (SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 64) WHERE o_orderstatus = 'F'")
def limit_then_filter(t):
    return groups.limit_then_filter(t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 64, F.col("o_orderstatus") == "F")


@query("SELECT source, count(DISTINCT lang) AS n_distinct, count(*) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) >= 2")
def distinct_having(t):
    return groups.distinct_having(t("documents"), ["source"], "lang", 2)


@query("SELECT doc_id, len(list_intersect(string_split_regex(lower(text), '[^a-z0-9]+'), ['license', 'apache', 'copyright', 'token'])) AS hits FROM documents WHERE list_has_any(string_split_regex(lower(text), '[^a-z0-9]+'), ['license', 'apache', 'copyright', 'token'])")
def token_overlap(t):
    wanted = F.array(*[F.lit(x) for x in ("license", "apache", "copyright", "token")])
    tokens = F.split(F.lower("text"), "[^a-z0-9]+")
    return t("documents").filter(F.arrays_overlap(tokens, wanted)).select("doc_id", F.size(F.array_intersect(tokens, wanted)).cast("long").alias("hits"))


@query("""WITH refs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages), names AS (SELECT regexp_extract(url, '^https?://[^/]*(/[^?]*)', 1) AS path FROM pages)
  SELECT target AS path, count(*) AS n, bool_or(target IN (SELECT path FROM names)) AS known FROM refs GROUP BY 1""")
def path_extract(t):
    refs = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("path"))
    names = t("pages").select(F.regexp_extract("url", "^https?://[^/]*(/[^?]*)", 1).alias("path")).distinct().withColumn("known", F.lit(True))
    return refs.groupBy("path").agg(F.count("*").alias("n")).join(names, "path", "left").select("path", "n", F.coalesce("known", F.lit(False)).alias("known"))


_ENC = "replace(replace(replace(replace(replace({0}, '%', '%25'), '|', '%7C'), chr(9), '%09'), chr(10), '%0A'), chr(13), '%0D')"


@query(f"SELECT doc_id, md5({_ENC.format('text')}) AS encoded, length({_ENC.format('text')}) AS n, true AS same FROM documents")
def percent_codec(t):
    e = T.percent_encode(F.col("text"))
    return t("documents").select("doc_id", F.md5(e).alias("encoded"), F.char_length(e).cast("long").alias("n"), (T.percent_decode(e) == F.col("text")).alias("same"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN (b * 10 // 1024) // 10 || '.' || (b * 10 // 1024) % 10 || 'K' ELSE (b * 10 // 1048576) // 10 || '.' || (b * 10 // 1048576) % 10 || 'M' END AS label
  FROM (SELECT doc_id, n_chars * 16 AS b FROM documents)""")
def human_sizes(t):
    return t("documents").select("doc_id", T.bytes_label_truncated(F.col("n_chars") * 16).alias("label"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 45")
def page_of_rows(t):
    return groups.page_of_rows(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3, 15)


@query("""SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE place % CAST(ceil(n / 8) AS BIGINT) = 0""")
def even_sample(t):
    placed = ranking.row_number(t("documents").select("source", "doc_id"), F.floor(F.col("doc_id") / 4096), ["doc_id"], keys=["source"])
    return groups.even_places(placed, ["source"], "place", 8)


@query("""SELECT source, lang, total, largest, n, total - largest AS reclaim, row_number() OVER (ORDER BY total - largest DESC, source, lang) AS place FROM (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS total, max(n_chars) AS largest, count(*) AS n FROM documents GROUP BY ALL)""")
def reclaim_rank(t):
    return groups.reclaim(t("documents"), ["source", "lang"], "n_chars").withColumn("place", F.row_number().over(Window.orderBy(F.desc("reclaim"), "source", "lang")))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000 + 0.5) AS BIGINT)) AS s FROM embeddings)
  SELECT a.vec_id, CAST(list_sum(list_transform(a.s, lambda x: x * x)) AS BIGINT) AS signal, CAST(list_sum(list_transform(list_zip(a.s, b.s), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS error FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def snr_pairs(t):
    v = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("next")), "vec_id")
    signal, error = quality.power_sums(F.col("e"), F.col("next"))
    return pairs.select("vec_id", signal.cast("long").alias("signal"), error.cast("long").alias("error"))


@query("SELECT event_type, median(value) AS median, count(value) AS n FROM events GROUP BY 1")
def median_trials(t):
    return quality.median_by(t("events"), ["event_type"], "value")


@query(f"SELECT p_brand, before, after, CASE WHEN saved <= 0 THEN 'NO_GAIN' WHEN saved * 100 < greatest(after, 1) * 5 THEN 'LOW_EFFICIENCY' ELSE 'CANDIDATE' END AS verdict FROM ({_BOARD})")
def efficiency_gate(t):
    return _board(t).select("p_brand", "before", "after", classify.efficiency(F.col("before"), F.col("after"), 5).alias("verdict"))


@query("""SELECT doc_id, toxic, saving, row_number() OVER (ORDER BY saving DESC NULLS LAST, doc_id) AS place FROM (SELECT doc_id, toxic, CASE WHEN quality = 1 THEN n_chars END AS saving FROM labels JOIN documents USING (doc_id))""")
def status_report_totals(t):
    rows = t("labels").join(t("documents"), "doc_id").select("doc_id", "toxic", F.when(F.col("quality") == 1, F.col("n_chars")).alias("saving"))
    # Rows without a saving come last, in buckets of their own by id.
    bucket = F.coalesce(F.floor(F.col("saving") / 256), -1 - F.floor(F.col("doc_id") / 4096))
    return ranking.row_number(rows, bucket, [F.desc_nulls_last("saving"), "doc_id"], descending=True)


@query(f"""SELECT user_id, a.v AS before, b.v AS after, b.v - a.v AS delta FROM (SELECT user_id, CASE WHEN event_id % 5 > 0 THEN {CENTS.format('value')} END AS v FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) a
  JOIN (SELECT user_id, CASE WHEN event_id % 5 > 0 THEN {CENTS.format('value')} END AS v FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) b USING (user_id)""")
def snapshot_delta(t):
    rows = t("events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_id") % 5 > 0, ratios.cents(F.col("value"))).alias("v"))
    ends = rows.groupBy("user_id").agg(F.min_by(F.struct("v"), "at").alias("a"), F.max_by(F.struct("v"), "at").alias("b"))
    return ends.select("user_id", F.col("a.v").alias("before"), F.col("b.v").alias("after"), (F.col("b.v") - F.col("a.v")).alias("delta"))


@query("""SELECT o_orderkey, stage FROM orders, (VALUES ('compress'), ('dedupe'), ('assets')) s(stage) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND ((stage = 'compress' AND l_linenumber = 1) OR (stage = 'dedupe' AND l_returnflag = 'R')))""")
def stage_resume(t):
    from ..jobs import resume

    done = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.explode(F.filter(F.array(F.when(F.col("l_linenumber") == 1, "compress"), F.when(F.col("l_returnflag") == "R", "dedupe")), lambda x: x.isNotNull())).alias("stage"), F.lit(0).alias("rc"))
    return resume.open_stages(t("orders").select("o_orderkey"), done, "o_orderkey", ["compress", "dedupe", "assets"])


@query("SELECT lower(c_mktsegment) || c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def uniqueness_violations(t):
    return latest.uniqueness_violations(t("customer"), F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")))


@query("SELECT event_type, first_seen, row_number() OVER (ORDER BY first_seen, event_type) AS place FROM (SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1)")
def ordered_distinct(t):
    return latest.ordered_distinct(t("events"), "event_type", "event_id")


@query("""WITH m AS (SELECT conv_id, turn, text, coalesce(sum(length(text) + 2) OVER w, 0) - CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) > 1 THEN 2 ELSE 0 END AS before FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT conv_id, md5(string_agg(text, ', ' ORDER BY turn, text) FILTER (WHERE before < 180)) AS message, count(*) FILTER (WHERE NOT before < 180) AS more FROM m GROUP BY 1""")
def cutoff_message(t):
    rows = t("conversations").filter("text is not null")
    found = groups.cutoff_message(rows.withColumn("body", F.col("text")), ["conv_id"], ["turn", "text"], "body", 180)
    return found.select("conv_id", F.md5("message").alias("message"), "more")


@query("SELECT event_type, k, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT event_type, unnest(json_keys(props)) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events) GROUP BY ALL")
def json_map_normalise(t):
    rows = t("events").select("event_type", F.explode(F.from_json("props", "map<string,long>")).alias("k", "v"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("""SELECT doc_id, hex(h[1:4]) AS magic, CAST(('0x' || hex(h[4:4]) || hex(h[3:3]) || hex(h[2:2]) || hex(h[1:1])) AS BIGINT) AS le32, octet_length(b) AS size FROM (SELECT doc_id, encode(text) AS b, encode(text)[1:4] AS h FROM documents) WHERE octet_length(b) >= 4""")
def binary_header_scan(t):
    b = F.col("text").cast("binary")
    return t("documents").filter(F.octet_length("text") >= 4).select("doc_id", F.hex(F.substring(b, 1, 4)).alias("magic"), headers.le_int(b, 0, 4).alias("le32"), F.octet_length("text").cast("long").alias("size"))


@query("""SELECT c_custkey, s_suppkey FROM (SELECT c_nationkey AS k, c_custkey FROM customer) JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1) USING (k)""")
def legacy_unique_match(t):
    once = latest.only_once(t("supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey"), "k")
    return t("customer").select(F.col("c_nationkey").alias("k"), "c_custkey").join(once, "k").select("c_custkey", "s_suppkey")


@query("""SELECT page_id, prefix FROM pages JOIN (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS prefix FROM pages) ON starts_with(url, prefix || '/')""")
def substring_theta(t):
    prefixes = t("pages").select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("prefix"))
    return lookup.prefix_matches(t("pages").select("page_id", "url"), "url", prefixes, "prefix").select("page_id", "prefix")


@query("""SELECT doc_id, name, CAST(124 + length(name) AS BIGINT) AS "offset", CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS md5 FROM (SELECT doc_id, text, 'res://doc_' || doc_id || '.txt' AS name FROM documents)""")
def pack_directory_rows(t):
    """Every document as a pack of one file, built here, and its directory as the decoder reads it."""
    from ..decode import scan

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    name = F.concat(F.lit("res://doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    head = F.concat(F.lit(b"GDPC"), headers.le_bytes(F.lit(1), 4), F.lit(bytes(76)), headers.le_bytes(F.lit(1), 4))
    entry = F.concat(headers.le_bytes(F.octet_length(name), 4), name.cast("binary"), headers.le_bytes(F.octet_length(name) + 124, 8), headers.le_bytes(F.octet_length(body), 8), F.unhex(F.md5(body)))
    packs = t("documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(head, entry, body).alias("content"))
    return scan.pack_entries(scan.decode_content(packs)).select(F.col("path").cast("long").alias("doc_id"), "name", "offset", "size", "md5")


@query("SELECT doc_id, 1 AS chunks, 1 AS packed, CAST(octet_length(encode(text)) AS BIGINT) AS packed_bytes FROM documents WHERE octet_length(encode(text)) > 0")
def package_chunks(t):
    """Every document as a package of one compressed chunk, built here; a package with an empty chunk is rejected."""
    from ..decode import scan

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0"))
    packages = t("documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit(b"\x20\0\0\x07\1"), size, body).alias("content"))
    return scan.package_rollup(scan.decode_content(packages)).select(F.col("path").cast("long").alias("doc_id"), F.col("chunks").cast("int").alias("chunks"), F.col("packed").cast("int").alias("packed"), "packed_bytes")


@query("""SELECT doc_id, 'PCM8' AS codec, CAST(8000 + doc_id AS BIGINT) AS rate, CAST(1 + doc_id % 2 AS BIGINT) AS channels, size, size // (1 + doc_id % 2) AS frames
  FROM (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS size FROM documents) WHERE size % (1 + doc_id % 2) = 0""")
def resource_samples(t):
    """Every document's bytes as the samples of a sound resource, built here, of one channel or two; those that are not whole frames are rejected."""
    from ..decode import scan

    named = lambda v: struct.pack("<I", len(v) + 1) + v + b"\0"
    word = lambda n: struct.pack("<I", n)
    kind, names = named(b"AudioStreamWAV"), [b"data", b"mix_rate", b"stereo"]
    head = b"RSRC" + struct.pack("<5I", 0, 0, 4, 3, 6) + kind + bytes(64) + word(len(names)) + b"".join(map(named, names)) + word(0) + word(1) + named(b"local://1")
    head += struct.pack("<Q", len(head) + 8) + kind + word(len(names)) + struct.pack("<2I", 0, 31)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    fill = F.substring(F.lit(bytes(3)), F.lit(1), F.pmod(-F.octet_length(body), F.lit(4)))
    rate = F.concat(F.lit(struct.pack("<2I", 1, 3)), headers.le_bytes(F.col("doc_id") + 8000, 4))
    stereo = F.concat(F.lit(struct.pack("<2I", 2, 2)), headers.le_bytes(F.col("doc_id") % 2, 4))
    content = F.concat(F.lit(head), headers.le_bytes(F.octet_length(body), 4), body, fill, rate, stereo, F.lit(b"RSRC"))
    found = scan.decode_content(t("documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    return scan.samples(found).select(F.col("path").cast("long").alias("doc_id"), "codec", "rate", "channels", "size", "frames")
