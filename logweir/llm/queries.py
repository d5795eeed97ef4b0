"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embeddings, langid, mixing, quality, secrets, simhash, token_counts, token_files, warc
from ._util import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, folder)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(~langid.held_out()).select(F.col("doc_id").alias("id"), "text", "lang")
    profiles = langid.learn(labelled)
    rows = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.identify(rows, profiles, ("doc_id", "held_out"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


#: Domains by label, and their shares of all tokens in the mix.
TARGETS = {"good": 0.9, "low": 0.07, "toxic": 0.03}
#: In the pipeline the quality rules have dealt with low quality; the good target is measured, so that rates fitted to it are near 1 for good documents and near 0 for toxic ones, whatever the toxic share.
PIPELINE_TARGETS = {"good": None, "toxic": 0.0}


def domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)``: toxic documents, others of low quality, and good ones."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ("doc_id",))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(spark, folder, with_bytes=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_simhash, op3_language_id, op4_token_counts, op5_byte_bpe, op6_mixing, op7_embeddings, op8_secrets, op9_quality_rules, op10_warc)}

ORACLES: dict[str, str] = {
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
             d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest, sha256(body) AS address FROM p),
             t AS (SELECT *, max(page_id) OVER (PARTITION BY address) AS top FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n < 1000 OR page_id = top THEN NULL ELSE top END AS refers_to
        FROM t""",
}
