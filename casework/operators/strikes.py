"""Batch form of the block rule I3 with E5 and D20."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIKES_TO_BLOCK = 15
RECENT_STRIKES = 20
MAX_AGE_DAYS = 2


def record(strikes: DataFrame, invalid: DataFrame, recorded_at) -> DataFrame:
    """Append one strike per invalid request."""
    fresh = invalid.select(
        F.lit(None).cast("bigint").alias("id"),
        "account_number",
        F.lit(str(recorded_at)).cast("timestamp_ntz").alias("created_at"),
    )
    return strikes.select("id", "account_number", "created_at").unionByName(fresh)


def recent(strikes: DataFrame, limit: int = RECENT_STRIKES) -> DataFrame:
    """E5: the newest strikes per account; the rank limit applies before the shuffle as well."""
    newest = Window.partitionBy("account_number").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return strikes.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def per_day(strikes: DataFrame) -> DataFrame:
    """D20."""
    return strikes.groupBy("account_number", F.col("created_at").cast("date").alias("day")).agg(
        F.count("*").alias("strikes")
    )


def blocked_accounts(strikes: DataFrame, now, threshold: int = STRIKES_TO_BLOCK, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Accounts whose strikes, at most `max_age_days` whole days old, reach the threshold on one day.

    Every young strike counts, however many came after it; the stream counts the same way."""
    moment = F.lit(str(now)).cast("timestamp_ntz")
    age = F.floor(F.timestamp_diff("SECOND", "created_at", moment) / 86400)
    young = strikes.where(age <= max_age_days)
    days = per_day(young).where(F.col("strikes") >= threshold)
    return days.groupBy("account_number").agg(F.max("strikes").alias("strikes_on_worst_day"))
