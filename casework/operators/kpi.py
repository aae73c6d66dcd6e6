"""Dashboard aggregates C5, D1-D12, D16, D19.

Every grouped count aggregates partially before its shuffle, so a value held by a third of all rows is one
partial row per task. Shares divide by a total taken over the grouped rows, never over the cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.functions import sla
from casework.schemas import AUTO_RESOLVED, SEVERITIES, lookup

LABEL_SHARE = 0.10
ALERT_PROBABILITY = 0.85
ALERT_CLUSTER = 20
ALERT_RISK = 80
VOLUME_TIERS = ((30, "Very high (30+)"), (15, "High (15-29)"), (5, "Moderate (5-14)"))
OTHER_TIER = "Other (<5)"


def _open() -> Column:
    return F.coalesce(F.col("status"), F.lit("open")) == "open"


def _at_risk() -> Column:
    return F.coalesce(F.col("sla_breach_prob"), F.lit(0.0)) >= 0.5


def counts(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("cases"))


def shares(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Counts of a closed vocabulary with their share and the label of large slices."""
    grouped = counts(df, key, name)
    total = F.sum("cases").over(Window.partitionBy())
    share = F.col("cases") / total
    text = F.concat(F.col(name), F.lit(" "), F.bround(F.col("share") * 100, 0).cast("long").cast("string"), F.lit("%"))
    return grouped.withColumn("share", share).select(
        name,
        "cases",
        F.round("share", 4).alias("share"),
        F.when(F.col("share") >= LABEL_SHARE, text).otherwise("").alias("label"),
    )


def service_stats(cases: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """D1 in long form (metric, key, value). One scan: the three groupings share it as grouping sets."""
    labelled = cases.select(
        F.coalesce("category", F.lit("Unprocessed")).alias("category"),
        F.coalesce("severity", F.lit("Unprocessed")).alias("severity"),
        "channel", "processed_at", "sla_breach_prob", "risk_score", "duplicate_of",
    )
    sets = labelled.groupingSets(
        [[], ["category"], ["severity"], ["channel"]], "category", "severity", "channel"
    ).agg(
        F.grouping_id("category", "severity", "channel").alias("set"),
        F.count("*").alias("total"),
        F.count("processed_at").alias("processed"),
        F.count_if(_at_risk()).alias("at_risk"),
        F.count("duplicate_of").alias("duplicates"),
        F.avg("sla_breach_prob").alias("avg_probability"),
        F.avg("risk_score").alias("avg_risk"),
    )

    def entry(metric: str, value: Column, key: Column | None = None) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            (F.lit("") if key is None else key).alias("key"),
            value.cast("double").alias("value"),
        )

    overall = F.array(
        entry("total", F.col("total")),
        entry("processed", F.col("processed")),
        entry("pending", F.col("total") - F.col("processed")),
        entry("at_risk", F.col("at_risk")),
        entry("duplicates", F.col("duplicates")),
        entry("avg_breach_probability", F.round(F.coalesce("avg_probability", F.lit(0.0)), 3)),
        entry("avg_risk_score", F.round(F.coalesce("avg_risk", F.lit(0.0)), 1)),
    )
    entries = (
        F.when(F.col("set") == 7, overall)
        .when(F.col("set") == 3, F.array(entry("by_category", F.col("total"), F.col("category"))))
        .when(F.col("set") == 5, F.array(entry("by_severity", F.col("total"), F.col("severity"))))
        .when(F.col("channel").isNotNull(), F.array(entry("by_channel", F.col("total"), F.col("channel"))))
    )
    stats = sets.select(F.inline(entries))
    if alerts is not None:
        counted = alerts.agg(F.count("*").cast("double").alias("value"))
        stats = stats.unionByName(
            counted.select(F.lit("root_cause_alerts").alias("metric"), F.lit("").alias("key"), "value")
        )
    return stats


def kpi_strip(cases: DataFrame) -> DataFrame:
    """At-risk and the mean count open cases only."""
    status = F.coalesce(F.col("status"), F.lit("open"))
    return cases.agg(
        F.count("*").alias("total"),
        F.count("processed_at").alias("processed"),
        F.count_if(_open() & _at_risk()).alias("at_risk"),
        F.count_if(status.isin(*AUTO_RESOLVED)).alias("auto_resolved"),
        F.round(F.coalesce(F.avg(F.when(_open(), F.col("sla_breach_prob"))), F.lit(0.0)), 4).alias("avg_breach"),
    )


def per_day(cases: DataFrame) -> DataFrame:
    """D3."""
    return counts(cases.where(F.col("date").isNotNull()), F.col("date"), "date")


def by_category(cases: DataFrame) -> DataFrame:
    """D4."""
    return shares(cases, F.coalesce("category", F.lit("Unknown")), "category")


def by_channel(cases: DataFrame) -> DataFrame:
    """D5."""
    return counts(cases, F.coalesce("channel", F.lit("Unknown")), "channel").orderBy("cases", "channel")


def by_sentiment(cases: DataFrame) -> DataFrame:
    """D6."""
    return shares(cases, F.coalesce("sentiment", F.lit("Unknown")), "sentiment")


def by_severity(cases: DataFrame) -> DataFrame:
    """Fixed order, other values after it; a missing severity is left out."""
    grouped = counts(cases.where(F.col("severity").isNotNull()), F.col("severity"), "severity")
    rank = lookup(F.col("severity"), {s: i for i, s in enumerate(SEVERITIES)}, len(SEVERITIES))
    return grouped.withColumn("position", rank).orderBy("position", "severity")


def breach_by_category(cases: DataFrame) -> DataFrame:
    """D8."""
    rows = cases.where(F.col("sla_breach_prob").isNotNull() & F.col("category").isNotNull())
    means = rows.groupBy("category").agg(F.round(F.avg("sla_breach_prob"), 4).alias("avg_breach"))
    return means.orderBy(F.col("avg_breach").desc(), "category")


def top_cities(cases: DataFrame, limit: int = 10) -> DataFrame:
    """D9."""
    grouped = counts(cases, F.coalesce("location", F.lit("Unknown")), "city")
    return grouped.orderBy(F.col("cases").desc(), "city").limit(limit)


def resolution_breakdown(cases: DataFrame, as_of) -> DataFrame:
    """D10."""
    bucket = sla.resolution_bucket(F.col("status"), F.col("sla_due_date"), as_of)
    return shares(cases, bucket, "bucket")


def sla_histogram(cases: DataFrame, as_of) -> DataFrame:
    """Five buckets in fixed order. One conditional aggregate fills empty buckets without a join."""
    days = sla.days_until_due(F.col("sla_due_date"), as_of)
    bucket = sla.sla_bucket(days)
    dated = cases.where(F.col("sla_due_date").isNotNull())
    wide = dated.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"), F.lit(name).alias("bucket"), F.count_if(bucket == name).alias("cases")
                )
                for i, name in enumerate(sla.SLA_BUCKETS)
            ]
        ).alias("buckets")
    )
    return wide.select(F.inline("buckets"))


def volume_tier(count: Column) -> Column:
    chain = F.when(count >= VOLUME_TIERS[0][0], VOLUME_TIERS[0][1])
    for least, name in VOLUME_TIERS[1:]:
        chain = chain.when(count >= least, name)
    return chain.otherwise(OTHER_TIER)


def city_volume(cases: DataFrame) -> DataFrame:
    """Cases per city with tier and marker size."""
    grouped = counts(cases.where(F.col("location").isNotNull()), F.col("location"), "location")
    return grouped.select(
        "location",
        "cases",
        volume_tier(F.col("cases")).alias("tier"),
        F.least(F.col("cases") * F.lit(0.75) + 7, F.lit(28.0)).alias("marker_size"),
    )


def labelled_cities(cases: DataFrame, limit: int = 4) -> DataFrame:
    """The cities that get a permanent label."""
    return city_volume(cases).orderBy(F.col("cases").desc(), "location").limit(limit)


def mapped_cities(cases: DataFrame, coordinates: DataFrame) -> DataFrame:
    """City volumes with coordinates. The dimension is a constant of the product (62 cities)."""
    return city_volume(cases).join(F.broadcast(coordinates), "location")


def alert_conditions(cases: DataFrame) -> DataFrame:
    """D16 over cases: critical open rows, high-risk customers, pending intake.

    Customers are first grouped, so the distinct count never ships their rows.
    """
    high = F.coalesce(F.col("risk_score"), F.lit(0)) > ALERT_RISK
    per_customer = cases.groupBy("customer_name").agg(
        F.count_if(_open() & (F.coalesce("sla_breach_prob", F.lit(0.0)) > ALERT_PROBABILITY)).alias("critical"),
        F.max(high).alias("high_risk"),
        F.count_if(F.col("processed_at").isNull()).alias("pending"),
    )
    return per_customer.agg(
        F.sum("critical").alias("critical_open"),
        F.count_if(F.col("customer_name").isNotNull() & F.col("high_risk")).alias("high_risk_customers"),
        F.sum("pending").alias("pending_intake"),
    )


def systemic_banner(alerts: DataFrame) -> DataFrame:
    """D16 over alerts (at most one per cluster): large clusters, their cases and a top-three preview."""
    big = alerts.where(F.col("count") >= ALERT_CLUSTER)
    ranked = big.withColumn(
        "_rank", F.row_number().over(Window.orderBy(F.col("count").desc(), "cluster_id"))
    )
    place = F.when(
        F.coalesce("location", F.lit("")) != "", F.concat(F.lit(" ("), "location", F.lit(")"))
    ).otherwise("")
    line = F.concat(F.col("count").cast("string"), F.lit(" "), "category", place)
    top = F.array_sort(F.collect_list(F.when(F.col("_rank") <= 3, F.struct("_rank", line.alias("line")))))
    return ranked.agg(
        F.count("*").alias("clusters"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("cases"),
        F.array_join(F.transform(top, lambda s: s["line"]), "; ").alias("preview"),
    )


def run_summary(enriched: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """What one enrichment run did."""
    failed = F.col("error").isNotNull() if "error" in enriched.columns else F.lit(False)
    out = enriched.agg(
        F.count("*").alias("processed"),
        F.count_if(failed).alias("errors"),
        F.count("duplicate_of").alias("duplicates_found"),
    )
    if alerts is None:
        return out
    return out.select("*", alerts.agg(F.count("*").alias("n")).scalar().alias("alerts_detected"))


def error_summary(enriched: DataFrame) -> DataFrame:
    """D19's errors by kind: stage, column, reason and the number of cases. A case with several errors counts in each."""
    return enriched.select(F.explode("errors").alias("e")).select("e.*").groupBy("stage", "column", "reason").agg(F.count("*").alias("cases"))
