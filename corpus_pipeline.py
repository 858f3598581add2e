"""The corpus pipeline: documents -> quality rules -> near-dedup -> secrets -> mix -> byte-level BPE.

Each stage reads what the one before it wrote. The first four return the columns of documents; the last one adds the
token ids of every document that is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import bpe, mixing, near_dedup, quality, secrets
from broadsheet.llm.queries import vocabulary
from broadsheet.llm.shared import shared_dir, small_batches

#: Near copies of the pipeline; 85 percent on three words is the contract of the query op1_near_dedup alone.
NEAR_PERCENT, NEAR_WORDS = 80, 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: similarity NEAR_PERCENT on shingles of NEAR_WORDS words."""
    small_batches(spark)
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT, shingle=NEAR_WORDS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts are replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources reach their target weights."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents without the text, with n_tokens, ids and whether decoding gives the text back."""
    small_batches(spark)
    coded = bpe.encode(docs, *vocabulary())
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.withColumn("round_trip", same).drop("text", "decoded")


STAGES = [
    ("quality rules", keep_good),
    ("near dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Registers, sketches and byte-pair merges have no SQL form; tests/llm holds run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
