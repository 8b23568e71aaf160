"""From raw documents to packed sequences: quality rules, line deduplication, near-duplicates,
secret scans, packing. Each stage reads what the one before it kept.

All stages but the last return the columns of documents, others (also with clashing names) included. Null and empty texts
fail the quality rules; rows without id take part like others; of rows that repeat id and text one leaves the
near-duplicate stage; an empty table gives no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import lines, minhash, packing, quality, secret_scan
from sensorloom.settings import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites stay where they occur first."""
    return lines.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays (five words, similarity 0.8), once where rows repeat it."""
    return minhash.one_row_each(minhash.drop_near_duplicates(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

# The network of the secret scans and the linear program of packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Stages meet in Parquet tables in the shared folder; each is
    removed once the next one is written (packing keeps its pieces in a checkpoint of its own)."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        _remove(spark, path)
        path = f"{base}/{name}"
        docs = spark.read.parquet(path)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    _remove(spark, base)
    return packed


def _remove(spark: SparkSession, path: str | None) -> None:
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
