"""A training-data pipeline over ``documents``: five stages, each one operator.

1. quality: rows that the quality rules reject go.
2. near_dedup: one row of each group of near duplicates stays.
3. secrets: secret spans are masked in the text.
4. mixing: good rows come once, rows that more probably are toxic go.
5. tokens: byte-level BPE ids of each text with their digests.

Stages 1 to 4 return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import byte_bpe, mixing, near_dedup, quality, queries, secrets
from logweir.llm._util import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return quality.judge(docs, tuple(docs.columns), prefix="__new_").where("__new_kept").select(*columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in docs.columns]
    labels = queries.domains(table(spark, sf_dir, "labels"))
    return mixing.resample(docs, labels, queries.PIPELINE_TARGETS).select(*columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("tokens", tokens_stage)]

#: The estimates, groups and rates of the stages have no SQL form; tests hold each stage to a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
