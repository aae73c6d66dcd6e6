"""Compliance report and its summary: H18-H20, D13, L5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions import sla
from casework.schemas import AUTO_RESOLVED


def compliance_report(cases: DataFrame, as_of) -> DataFrame:
    """Ten columns per case, one projection."""
    due = F.col("sla_due_date")
    return cases.select(
        F.col("id").alias("Complaint ID"),
        F.col("customer_name").alias("Customer Name"),
        F.coalesce("category", F.lit("General")).alias("Type"),
        F.coalesce("severity", F.lit("Medium")).alias("Severity"),
        F.col("channel").alias("Channel"),
        F.col("date").alias("Date Filed"),
        due.alias("SLA Deadline"),
        sla.days_until_due(due, as_of).alias("Days Remaining"),
        sla.breach_status(due, F.col("sla_breach_prob"), as_of).alias("Breach Status"),
        sla.resolution_status(F.col("status"), F.col("duplicate_of"), due, as_of).alias("Resolution Status"),
    )


def summary(cases: DataFrame, as_of) -> DataFrame:
    """D13 totals: an escalated case is in no bucket."""
    status = F.coalesce("status", F.lit("open"))
    is_open = status == "open"
    late = F.coalesce(F.col("sla_due_date") < sla.day(as_of), F.lit(False))
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if(status == "resolved").alias("resolved"),
        F.count_if(status.isin(*AUTO_RESOLVED)).alias("auto_resolved"),
        F.count_if(is_open & ~late).alias("pending"),
        F.count_if(is_open & late).alias("breached"),
    )


def summary_by_category(cases: DataFrame) -> DataFrame:
    """D13 by category."""
    return cases.groupBy(F.coalesce("category", F.lit("General")).alias("category")).agg(F.count("*").alias("cases"))
