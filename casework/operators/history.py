"""Per-customer history: C1, C2, D17, D18, E1, E2, K19."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions import risk
from casework.operators.skew import attach_by_key
from casework.schemas import PUBLIC_CHANNELS


def complaint_counts(cases: DataFrame, counted_in: DataFrame | None = None) -> DataFrame:
    """Cases per named customer, joined to every case; a null name has no count. `counted_in`: what to count, else `cases`."""
    source = cases if counted_in is None else counted_in
    counts = source.where(F.col("customer_name").isNotNull()).groupBy("customer_name").agg(
        F.count("*").alias("customer_complaint_count")
    )
    counts = counts.withColumn("_w", F.col("customer_complaint_count"))
    return attach_by_key(cases, counts, "customer_name", "_w", "id")


def histories(cases: DataFrame, key: str = "customer_name") -> DataFrame:
    """One row per customer. Grouping by category first keeps both shuffles small for a hot customer."""
    public = F.col("channel").isin(*PUBLIC_CHANNELS)
    upset = F.col("sentiment").isin(*risk.UPSET)
    unresolved = F.coalesce(F.col("status"), F.lit("open")) == "open"
    by_category = cases.groupBy(key, F.nullif(F.col("category"), F.lit("")).alias("_category")).agg(
        F.count("*").alias("n"),
        F.count_if(upset).alias("upset"),
        F.count_if(unresolved).alias("unresolved"),
        F.count_if(public).alias("public"),
    )
    return by_category.groupBy(key).agg(
        F.sum("n").alias("filed"),
        F.sum("upset").alias("upset"),
        F.sum("unresolved").alias("unresolved"),
        F.sum("public").alias("public"),
        F.count("_category").alias("categories"),
    )


def with_history(cases: DataFrame, history_of: DataFrame | None = None) -> DataFrame:
    """C2 joined to the cases; unnamed customers share the empty name, as one history."""
    named = cases.withColumn("_customer", F.coalesce("customer_name", F.lit("")))
    source = named if history_of is None else history_of.withColumn("_customer", F.coalesce("customer_name", F.lit("")))
    per_customer = histories(source, "_customer").withColumn("_w", F.col("filed"))
    joined = attach_by_key(named, per_customer, "_customer", "_w", "id").drop("_customer")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("filed", "upset", "unresolved", "public", "categories")}
    return joined.withColumns(zero)


def scored(with_counts: DataFrame, probability: str = "sla_breach_prob") -> DataFrame:
    """H21-H24 on rows that carry their history counts; replaces the four risk columns."""
    c = F.col
    raw = with_counts.drop("risk_score", "risk_ombudsman", "risk_churn", "risk_social").withColumns(
        {
            "_o": risk.ombudsman(c(probability), c("severity"), c("amount_involved"), c("filed"), c("upset")),
            "_c": risk.churn(c("severity"), c("sentiment"), c("filed"), c("unresolved"), c("categories")),
            "_s": risk.social(c("severity"), c("sentiment"), c("channel"), c("public")),
        }
    )
    return raw.withColumns(
        {
            "risk_score": risk.overall(c("_o"), c("_c"), c("_s")),
            "risk_ombudsman": risk.clipped(c("_o")),
            "risk_churn": risk.clipped(c("_c")),
            "risk_social": risk.clipped(c("_s")),
        }
    ).drop("_o", "_c", "_s", "filed", "upset", "unresolved", "public", "categories")


def recompute_risk(cases: DataFrame) -> DataFrame:
    """Risk of every processed case from the processed history of its customer."""
    return scored(with_history(cases.where(F.col("processed_at").isNotNull())))


def latest_scored(cases: DataFrame) -> DataFrame:
    """The latest scored case per customer."""
    rows = cases.where(F.col("risk_score").isNotNull() & F.col("customer_name").isNotNull())
    newest = F.max_by(F.struct("id", "date", "risk_score"), F.struct("date", "id"))
    return rows.groupBy("customer_name").agg(newest.alias("_r")).select(
        "customer_name",
        F.col("_r.id").alias("id"),
        F.col("_r.date").alias("date"),
        F.col("_r.risk_score").alias("risk_score"),
        risk.risk_tier(F.col("_r.risk_score")).alias("tier"),
    )


def emotion_timeline(cases: DataFrame, customer: str | None = None) -> DataFrame:
    """Cases of one customer, or of all, in filing order with their emotion level.

    Of all customers each partition is in order, not the whole: rows are dealt by customer and month, so a hot customer is
    spread over its months.
    """
    rows = cases if customer is None else cases.where(F.col("customer_name") == customer)
    levels = rows.select(
        "customer_name", "date", "id", "category", "severity", "sentiment", "amount_involved",
        risk.emotion_rank(F.col("sentiment")).alias("emotion_level"),
    )
    if customer is not None:
        return levels.orderBy("customer_name", "date", "id")
    return levels.repartition("customer_name", F.trunc("date", "month")).sortWithinPartitions("customer_name", "date", "id")


def customer_totals(cases: DataFrame) -> DataFrame:
    """Cases filed and categories touched per customer."""
    rows = cases.where(F.col("customer_name").isNotNull())
    by_category = rows.groupBy("customer_name", "category").agg(F.count("*").alias("n"))
    return by_category.groupBy("customer_name").agg(
        F.sum("n").alias("complaints"), F.count("category").alias("categories")
    )


def busiest_customer(cases: DataFrame) -> DataFrame:
    """D17."""
    return (
        cases.where(F.col("customer_name").isNotNull())
        .groupBy("customer_name")
        .agg(F.count("*").alias("complaints"))
        .orderBy(F.col("complaints").desc(), "customer_name")
        .limit(1)
    )


def customer_view(cases: DataFrame) -> DataFrame:
    """L4: totals and latest score per customer."""
    return customer_totals(cases).join(
        latest_scored(cases).select(
            "customer_name", F.col("id").alias("latest_id"), F.col("risk_score").alias("latest_risk"), "tier"
        ),
        "customer_name",
        "left",
    )
