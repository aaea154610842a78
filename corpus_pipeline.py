"""The corpus pipeline: ``documents`` to packed training windows in five stages.

Each stage works on all rows that its predecessor kept, is written as Parquet to the
session's shared folder and read again as the next one's input; a stage that is lost is
run again from there.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm import exact_dedup, near_dedup, packing, pu_quality, secret_scan
from lapse.llm.common import drop_dir, read_table, work_dir, written
from lapse.llm.queries import TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    fitted = pu_quality.train(docs, read_table(spark, sf_dir, "labels"))
    return pu_quality.accepted(docs, fitted and fitted[0])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (up to A-Z case), the one of largest id."""
    return exact_dedup.keep_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.keep_one(docs, width=5)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark of their kind."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("secret scan", secret_stage),
    ("packing", packing_stage),
]

#: Model scores, MinHash groups and tokens aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{i}")
        if i:
            drop_dir(spark, f"{folder}/{i - 1}")
    return docs
