"""Documents through the corpus operators: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage works on all that its predecessor kept, is written as Parquet and read again by the next. The first four return
the columns of `documents`, n_chars counted anew where texts change; the last returns a row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm import decontamination, packing, quality, secret_scan, simhash
from casework.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and of the others the lines of more than ten documents of a host of any size."""
    return _counted(quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; SimHashes of three-word shingles link at three or fewer differing bits."""
    return simhash.deduplicate(docs, size=3, radius=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by its kind; every document stays."""
    return _counted(secret_scan.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised, cut and packed into sequences of 2048."""
    placed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return placed.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secrets),
    ("best-fit packing", best_fit_packing),
]
#: Fingerprints, entropy windows and packing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
