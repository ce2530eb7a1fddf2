"""The corpus pipeline: raw documents in, packed training sequences out. Counted as part of the llm subpackage."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.llm import fm_decontam, near_copies, packing, quality_rules, secret_scans
from ledgerweave.llm.batches import small_batches
from ledgerweave.sources.shared_folder import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    small_batches(spark)
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, directly or by way of others, the one with the smallest id stays.

    SimHash fingerprints and pivot tables give the first candidates; what lies further apart than three bits comes from a prefix filter (`near_copies`).
    """
    small_batches(spark)
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if a twentieth of their words or more stand in passages of the benchmark."""
    small_batches(spark)
    return fm_decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    small_batches(spark)
    return secret_scans.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document with its place."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("best_fit_packing", packed),
]

#: Tokenizers, fingerprints and packing cannot be expressed in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written to the shared folder and read again by the next."""
    folder = posixpath.join(ensure_checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = posixpath.join(folder, f"{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
