"""Human feedback: A10, C8, D14, D15, E6."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators.store import patch
from casework.schemas import HIGH_CONFIDENCE, UPDATABLE


def latest_corrections(feedback: DataFrame) -> DataFrame:
    """The last correction per case and field; partial aggregation, no window."""
    usable = feedback.where(
        ~F.col("is_correct")
        & (F.coalesce("corrected_value", F.lit("")) != "")
        & F.col("field").isin(*UPDATABLE)
    )
    return usable.groupBy("complaint_id", "field").agg(
        F.max_by("corrected_value", F.struct("created_at", "id")).alias("corrected_value")
    )


def listing(feedback: DataFrame, complaint: int | str | None = None) -> DataFrame:
    """Reviews newest first, of all complaints or of one."""
    rows = feedback if complaint is None else feedback.where(F.col("complaint_id") == complaint)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc())


def apply_corrections(cases: DataFrame, feedback: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Pivot the last corrections to one row per case and patch the cases."""
    wide = (
        latest_corrections(feedback)
        .groupBy("complaint_id")
        .pivot("field", list(fields))
        .agg(F.first("corrected_value"))
        .withColumnRenamed("complaint_id", "id")
    )
    flagged = wide.withColumns({f"{c}_set": F.col(c).isNotNull() for c in fields})
    return patch(cases, flagged)


def stats(feedback: DataFrame) -> DataFrame:
    """D14 totals; the rate is null without feedback."""
    counted = feedback.agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"))
    return counted.select(
        "total",
        "correct",
        (F.col("total") - F.col("correct")).alias("corrections"),
        F.try_divide("correct", "total").alias("accuracy_rate"),
    )


def corrections_by_field(feedback: DataFrame) -> DataFrame:
    """D14 by field."""
    return feedback.where(~F.col("is_correct")).groupBy("field").agg(F.count("*").alias("corrections"))


def agreement(cases: DataFrame, confidences: dict[str, str]) -> DataFrame:
    """Agreement share per label family, over the rows that carry a confidence."""
    wide = cases.agg(
        *[
            F.struct(
                F.lit(name).alias("family"),
                F.count_if(F.col(column) == HIGH_CONFIDENCE).alias("agreed"),
                F.count(column).alias("compared"),
            ).alias(name)
            for name, column in confidences.items()
        ]
    )
    long = wide.select(F.inline(F.array(*confidences)))
    return long.withColumn("percent", F.round(F.try_divide(F.col("agreed") * 100, F.col("compared")), 1))
