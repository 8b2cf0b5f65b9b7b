"""The pipeline's stages: each works on what its predecessor kept and its decisions take effect."""

import random
import shutil

import corpus_pipeline
import pytest
from siltstone.llm import common, exact_dedup, mixing, sentencepieces, simhash, toxicity

from ..conftest import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, after = docs, common.store(stage(spark, docs, DATA), name)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(before, labels).filter("toxic").collect()}
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
        elif name == "exact_dedup":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in exact_dedup.exact_dedup(before).filter("kept").collect()}
        elif name == "near_dedup":
            assert {r.doc_id for r in after.collect()} == {r.component_id for r in simhash.near_components(before).collect()}
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).filter("taken > 0 and copies > 0").collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
        if name != "encoding":
            assert after.columns == columns
        docs = after
    coder = sentencepieces.Encoder(sentencepieces.load_model(corpus_pipeline.TOKENIZER))
    texts = {r.doc_id: r.text for r in before.collect()}
    assert docs.count() == before.count() and all(coder.decode(r.ids) == texts[r.doc_id] for r in docs.collect())
    rows = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.ids_crc32) for r in rows.collect()) == sorted((r.doc_id, r.ids_crc32) for r in docs.collect())


@pytest.fixture
def planted(spark, tmp_path):
    """Clean documents, and beside them a copy, a copy but for white space, near copies and toxic documents."""
    rng = random.Random(12)
    clean = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for i in range(60)]
    near = clean[2][1].split()
    near[100] = "changed"
    toxic = [(i, " ".join(f"w{rng.randrange(5000)}" if rng.random() < 0.97 else "scum" for _ in range(200))) for i in range(300, 360)]
    rows = [*clean, (100, clean[0][1]), (101, clean[1][1].replace(" ", "\n")), (102, " ".join(near)), *toxic, (400, None), (401, "")]
    folder = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 300)) for i, _ in clean + toxic if i % 3], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
    yield str(folder), {i for i, _ in clean}
    shutil.rmtree(folder)


def test_planted_rows(spark, planted):
    folder, clean = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = common.store(stage(spark, docs, folder), name)
        kept = {r.doc_id for r in docs.collect()}
        assert clean <= kept, name
    assert kept == clean | {400} or kept == clean | {401}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
