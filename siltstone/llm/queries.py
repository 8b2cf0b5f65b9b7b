"""The queries of the training-text operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, toxicity
from .exact_dedup import exact_dedup
from .html_text import extract
from .mixing import mix
from .neighbours import search
from .sentencepieces import encode_documents
from .simhash import simhash_components
from .substring_dedup import remove_repeats
from .token_files import token_files



def tokenizer(name: str) -> str:
    """Where a vocabulary file of the public tokenizers is; it is read from there and never copied."""
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip."""
    found = encode_documents(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids_crc32", "round_trip")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    profiles = language_id.fit(docs.filter(~held_out))
    found = language_id.predict(docs, profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"), width=3, threshold=2)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op10_additive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"), every=100, k=10)


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, pos, ws[pos] AS word FROM t, unnest(range(1, len(ws) + 1)) AS u(pos)),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM t, unnest(range(1, len(ws) - 11)) AS u(i)),
m AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT g.doc_id, i FROM g JOIN m USING (gram) WHERE least < g.doc_id), unnest(range(0, 13)) AS u(j)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS body FROM w ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_html_main_text, op2_source_mixing, op3_substring_dedup, op4_sentencepiece, op5_language_id, op6_toxicity, op7_simhash_near_dedup, op8_token_files, op9_exact_dedup, op10_additive_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op9_exact_dedup": OP9_SQL}
