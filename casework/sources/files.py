"""File sources and sinks A1, A7, A9, A19."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework import schemas

_BOM = "﻿"


def read_seed_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A1: raw complaints from JSON. A JSON array cannot be split; large loads should use `lines=True`."""
    return spark.read.schema(schemas.RAW_CASE).json(path, multiLine=not lines)


def write_report_csv(report: DataFrame, folder: str, as_of: date | str) -> str:
    """A7 + A19: UTF-8 CSV with header and byte-order mark under a dated folder.

    Every task writes its own part file with its own header, so no file passes through one task.
    """
    path = f"{folder}/report_date={as_of}"
    first, *rest = report.columns
    marked = report.select(F.col(f"`{first}`").alias(_BOM + first), *[F.col(f"`{c}`") for c in rest])
    marked.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return path


def write_report_json(report: DataFrame, summary: DataFrame, folder: str, as_of: date | str) -> str:
    """Rows and summary as JSON lines; NaN becomes null."""
    path = f"{folder}/report_date={as_of}"
    clean = report.select(
        *[
            (F.when(F.isnan(f"`{name}`"), None).otherwise(F.col(f"`{name}`")) if kind in ("double", "float") else F.col(f"`{name}`"))
            .alias(name)
            for name, kind in report.dtypes
        ]
    )
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/rows")
    summary.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/summary")
    return path


def write_cases(df: DataFrame, path: str, mode: str = "append") -> None:
    """Case table at rest: Parquet by filing month, so date predicates prune folders."""
    (
        df.withColumn("filed_month", F.date_format("date", "yyyy-MM"))
        .write.mode(mode)
        .partitionBy("filed_month")
        .parquet(path)
    )
