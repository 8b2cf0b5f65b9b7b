"""Odd rows and clashing columns: every operator and stage gives for them what it gives for plain tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from siltstone import shipping
from siltstone.llm import exact_dedup, language_id, mixing, queries, sentencepieces, simhash, substring_dedup, token_files, toxicity

PIECES, BPE = queries.tokenizer("piece_bpe_32k.model"), queries.tokenizer("byte_bpe_50k.json")
LONG = "very long text of many words " * 8_000
ROWS = [
    (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "other words here", "en", "s", 2), (1, "a b c d e f", "de", "t", 3), (None, "a b c d e f", "en", None, 4), (None, "unique words", None, "s", 5), (2, None, "en", "s", None),
    (3, "", "en", "", 0), (4, " \t\n", "en", "s", 3), (5, LONG, "en", "s", 9), (6, LONG, "en", "t", 9), (7, "x", "en", "t", 1), (8, "zz", "en", "s", 2), (8, "z  z", "en", "s", 4), (9, "ünï 日本 \u0000 q", "fr", "s", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = "_node _key _text _gone _rows _copy _id _hash node key row rows copy copies id hash c0 c1 c7 fp doc size weight part mix_key text_hash plan_id begins ends spans tie keep_id digest label severity grade toxic score component_id quality start".split()


@pytest.fixture
def tables(spark):
    """The plain table, and the same with many more columns, two of one name among them."""
    plain = spark.createDataFrame(ROWS, SCHEMA)
    more = plain
    for i, name in enumerate(CLASHING):
        more = more.withColumn(name, F.lit(i) if i % 3 else F.lit(f"v{i}"))
    return plain, more.toDF(*[c if c != "n_chars" else "Node" for c in more.columns])


def rows_of(df, n=None):
    return sorted(map(repr, ([tuple(r)[:n] if n else tuple(r) for r in df.collect()])))


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 0, 5), (7, 1, 6), (None, 1, 7)], "doc_id long, toxic int, label int")


OPERATORS = {
    "mixing": lambda d, _: mixing.mix(d).drop("text_hash", "mix_key"),
    "substring": lambda d, _: substring_dedup.remove_repeats(d),
    "pieces": lambda d, _: sentencepieces.encode_documents(d, PIECES),
    "language": lambda d, _: language_id.predict(d, language_id.fit(d)),
    "toxicity": lambda d, labels: toxicity.toxicity(d, labels),
    "simhash": lambda d, _: simhash.simhash_components(d),
    "near": lambda d, _: simhash.near_components(d),
    "tokens": lambda d, _: token_files.token_files(d, BPE),
    "exact": lambda d, _: exact_dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(tables, labels, name):
    plain, more = tables
    got = rows_of(OPERATORS[name](plain, labels))
    assert len(got) == len(ROWS) and rows_of(OPERATORS[name](more, labels)) == got
    assert OPERATORS[name](more.filter("false"), labels).count() == 0


STAGES = {"toxicity": lambda d, labels: toxicity.keep_documents(d, labels), "exact": lambda d, _: exact_dedup.keep_documents(d), "near": lambda d, _: simhash.keep_documents(d), "mixing": lambda d, _: mixing.mixed_documents(d)}


@pytest.mark.parametrize("name", STAGES)
def test_stages(tables, labels, name):
    plain, more = tables
    out = STAGES[name](more, labels)
    assert out.columns == more.columns and STAGES[name](more.filter("false"), labels).count() == 0
    own = rows_of(more)
    assert all(r in own for r in rows_of(out))
    assert rows_of(out, 2) == rows_of(STAGES[name](plain, labels), 2)


def test_rows_of_one_id_are_told_apart_by_text(spark):
    for rows, want in (
        ([(1, "a"), (1, "a"), (1, "b")], [(1, "a"), (1, "b")]),
        ([(2, "same"), (1, "same"), (2, "wholly different")], [(1, "same"), (2, "wholly different")]),
        ([(None, "a"), (None, "a"), (None, "b")], [(None, "a"), (None, "b")]),
        ([(5, "zz"), (5, "z  z"), (5, "other")], [(5, "z  z"), (5, "other")]),
    ):
        got = exact_dedup.keep_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_equal_rows_of_two_sources_keep_their_copies(spark):
    rows = [(i, f"w{i} x", "a") for i in range(40)] + [(i, f"w{i} x", "b") for i in range(12)] + [(3, "w3 x", "a")] * 3
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, place long")
    want: dict = {}
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.mix_key] = want.get((r.doc_id, r.mix_key), 0) + r.copies
    got: dict = {}
    seen: dict = {}
    for r in mixing.mixed_documents(df).collect():
        got[r.doc_id, "a" + r.source] = got.get((r.doc_id, "a" + r.source), 0) + 1
        seen.setdefault((r.doc_id, r.source), {}).setdefault(r.place, 0)
        seen[r.doc_id, r.source][r.place] += 1
    assert got == {k: n for k, n in want.items() if n} and all(max(s.values()) - min(s.values()) <= 1 for s in seen.values())


def test_documents_the_mix_takes_against_brute_force(spark):
    """Which documents are taken: the keys, the prefix up to the budget, and the one nearest to the gap, computed plainly."""
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(["w1"] * rng.randrange(1, 30)) + " 12" * rng.randrange(4), "abc"[rng.randrange(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = {r.doc_id: r.key for r in df.select("doc_id", mixing.exponential_key(mixing.letter_share(F.col("text")), 17, F.col("doc_id"), F.xxhash64("text")).alias("key")).collect()}
    found = {r.doc_id: r for r in mixing.mix(df).collect()}
    for source in "abc":
        own = sorted((r for r in rows if r[2] == source), key=lambda r: keys[r[0]])
        size = {r[0]: len(r[1].split()) for r in own}
        target, whole = found[own[0][0]].target, sum(size.values())
        epochs = int(target // whole)
        budget, run, copies = target - epochs * whole, 0, dict.fromkeys(size, epochs)
        for i, *_ in own:
            if run + size[i] > budget:
                break
            run += size[i]
            copies[i] += 1
        rest = [(abs(size[i] - (budget - run)), keys[i], i) for i in size if copies[i] == epochs]
        if rest and budget > 0 and min(rest)[0] < budget - run:
            copies[min(rest)[2]] += 1
        assert {i: found[i].copies for i in size} == copies


def test_buckets_of_the_mix_are_even(spark):
    rows = [(i, ("w " if i % 2 else "1 ") * 3, "s") for i in range(40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", F.lit("s").alias("mix_key"), mixing.letter_share(F.col("text")).alias("weight"))
    df = df.withColumn("key", mixing.exponential_key(F.col("weight"), 17, F.col("doc_id"))).join(mixing._weights(df), "mix_key")
    sizes = [r["count"] for r in df.withColumn("part", F.floor(mixing._share_before(F.col("key"), F.col("weights")) * 64)).groupBy("part").count().collect()]
    assert len(sizes) >= 60 and max(sizes) < 4 * 40_000 / 64


def test_a_shared_folder_is_needed_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, getConf, getCheckpointDir = "spark://host:7077", staticmethod(lambda: Conf), staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shipping.shared_dir(Session)


def test_pipeline_on_odd_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.round_trip for r in got) and {r.doc_id for r in got} <= {r[0] for r in ROWS}
