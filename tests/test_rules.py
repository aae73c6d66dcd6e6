"""Hand-computed dates, probabilities, statuses, scores and labels."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casework import schemas
from casework.functions import labels, risk, sla, vectors
from casework.operators import history, report

DAYS = {
    "UPI": (2, 4, 5, 6), "ATM": (2, 4, 5, 6), "Card": (4, 5, 7, 8), "NetBanking": (4, 5, 7, 8),
    "Loan": (15, 21, 30, 36), "General": (15, 21, 30, 36), None: (15, 21, 30, 36),
}


def test_sla_days_round_half_to_even(spark):
    rows = [(c, s) for c in DAYS for s in schemas.SEVERITIES]
    df = spark.createDataFrame([*rows, ("UPI", None), ("UPI", "odd")], "c string, s string")
    got = [r[0] for r in df.select(sla.sla_days(F.col("c"), F.col("s"))).collect()]
    assert got == [d for c in DAYS for d in DAYS[c]] + [5, 5]


def test_breach_rule(spark):
    rows = [("Critical", 30000.0, 0.63), ("High", None, 0.38), ("Medium", 25000.0, 0.28), ("Low", 0.0, 0.10), (None, None, 0.18)]
    df = spark.createDataFrame([r[:2] for r in rows], "s string, a double")
    assert [r[0] for r in df.select(sla.breach_rule(F.col("s"), F.col("a"))).collect()] == [r[2] for r in rows]


def test_risk_of_a_single_case(spark):
    df = spark.createDataFrame(
        [(1, "C", "twitter", "Critical", "Angry", "UPI", 100000.0, 0.63, "open", "2026-05-01")],
        "id int, customer_name string, channel string, severity string, sentiment string, category string, amount_involved double, "
        "sla_breach_prob double, status string, processed_at string",
    )
    row = history.recompute_risk(df).first()
    assert (row["risk_ombudsman"], row["risk_churn"], row["risk_social"], row["risk_score"]) == (72, 37, 60, 58)


def test_risk_is_clipped_after_the_mix_and_unnamed_cases_share_a_history(spark):
    one = ("twitter", "Critical", "Angry", "UPI", 100000.0, 1.0, "open", "x")
    df = spark.createDataFrame(
        [(i, None if i % 2 else "", *one) for i in range(8)],
        "id int, customer_name string, channel string, severity string, sentiment string, category string, amount_involved double, "
        "sla_breach_prob double, status string, processed_at string",
    )
    rows = history.recompute_risk(df).collect()
    assert len(rows) == 8
    assert {r["risk_ombudsman"] for r in rows} == {100}
    assert {r["risk_churn"] for r in rows} == {30 + 25 + 6 + 12 + 8}
    assert {r["risk_social"] for r in rows} == {45 + 18 + 22 + 8}
    assert {r["risk_score"] for r in rows} == {round(0.45 * 105 + 0.30 * 81 + 0.25 * 93)}


def test_report_statuses(spark):
    rows = [
        ("2026-05-28", 0.1, "open", None, "Breached", "Breached", -1),
        ("2026-05-29", 0.5, "open", None, "At Risk", "Pending", 0),
        ("2026-06-10", 0.2, "resolved", None, "On Track", "Resolved", 12),
        ("2026-06-10", None, None, "X", "On Track", "Auto-Resolved (Duplicate)", 12),
        (None, 0.9, "escalated", None, "Unknown", "Escalated", None),
        (None, None, "open", "", "Unknown", "Pending", None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "due string, p double, status string, duplicate_of string").select(
        F.lit("i").alias("id"), F.lit("n").alias("customer_name"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("severity"), F.lit("email").alias("channel"), F.lit(None).cast("date").alias("date"),
        F.col("due").cast("date").alias("sla_due_date"), F.col("p").alias("sla_breach_prob"), "status", "duplicate_of",
    )
    got = report.compliance_report(df, "2026-05-29").collect()
    assert [(r["Breach Status"], r["Resolution Status"], r["Days Remaining"]) for r in got] == [r[4:] for r in rows]
    assert (got[0]["Type"], got[0]["Severity"]) == ("General", "Medium")


def test_report_summary_leaves_escalated_out(spark):
    df = spark.createDataFrame(
        [("open", "2026-05-28"), ("open", None), ("escalated", "2026-05-01"), (None, "2026-06-01"), ("auto_resolved_std", None)],
        "status string, due string",
    ).select("status", F.col("due").cast("date").alias("sla_due_date"))
    assert tuple(report.summary(df, "2026-05-29").first()) == (5, 0, 1, 2, 1)


def test_weekday_and_elapsed_share(spark):
    row = spark.sql("select date '2026-05-29' d").select(
        sla.weekday(F.col("d")), sla.hours_since(F.col("d"), "2026-05-31"), sla.sla_share_elapsed(F.lit(48.0), F.lit(4))
    ).first()
    assert tuple(row) == (4, 48.0, 0.5)


def test_priority_composite(spark):
    def score(*args):
        return spark.range(1).select(risk.priority_composite(*[F.lit(a) for a in args])).first()[0]

    assert score("Critical", "Angry", 500000.0, 9, 90, 0, 1.0) == 100.0
    assert score("Low", "Polite", 0.0, 1, 0, 1, 0.0) == 0.0
    assert score("High", "Neutral", 5000.0, 2, 10, 1, 0.5) == pytest.approx(24 + 7 + 1 + 6 + 4 + 9 - 8)
    assert score("High", "Neutral", 5000.0, 2, 10, 0, 0.0) == pytest.approx(24 + 7 + 1 + 6 + 4)


def test_labels(spark):
    one = spark.range(1)
    yes, none = F.lit(True), F.lit(None).cast("string")
    row = one.select(
        labels.category_agreement(F.lit("UPI"), F.lit("UPI")), labels.category_agreement(F.lit("UPI"), F.lit("ATM")),
        labels.category_agreement(F.lit(""), F.lit("ATM")), labels.sentiment_agreement(F.lit("Frustrated"), F.lit("negative")),
        labels.sentiment_agreement(F.lit("Odd"), F.lit("neutral")), labels.sentiment_agreement(F.lit("Polite"), none),
        labels.resolution(yes, F.lit("UPI"), F.lit("High"), F.lit("Angry")),
        labels.resolution(~yes, F.lit("UPI"), F.lit("Medium"), F.lit("Polite")),
        labels.resolution(~yes, F.lit("UPI"), F.lit("High"), F.lit("Polite")),
        labels.badge(none, F.lit("Needs Review")), labels.badge(F.lit("UPI"), F.lit("Needs Review")),
        labels.percent(F.lit(0.125)), labels.percent(F.lit(0.135)), labels.rupees(F.lit(1234.5)), labels.rupees(F.lit(0.0)),
        labels.scorer_bucket(F.lit("LABEL_2")), labels.scorer_bucket(F.lit("Mixed")),
        labels.iso_instant(F.lit(dt.datetime(2026, 5, 29, 1, 2, 3, 999)).cast("timestamp_ntz")),
    ).first()
    assert tuple(row) == (
        "High Confidence", "Needs Review", "Unknown", "High Confidence", "High Confidence", "Unknown",
        "auto_resolved_dup", "auto_resolved_std", "open", "-", "UPI (*)", "12%", "14%", "Rs 1,234", "-", "positive", "mixed",
        "2026-05-29T01:02:03Z",
    )


def test_tiers_and_ranks(spark):
    df = spark.createDataFrame([(70, "Angry"), (69, "Polite"), (40, "x"), (39, None), (None, "Neutral")], "v int, s string")
    got = df.select(risk.risk_tier(F.col("v")), risk.emotion_rank(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("Critical", 4), ("High", 1), ("High", 0), ("Low", 0), ("Medium", 2)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(F.round(vectors.cosine(F.col("a"), F.col("b")), 4)).collect()]
    assert got == [0.7071, None]
    assert spark.sql("select '[0.5, -1]' t").select(vectors.parse_vector(F.col("t"))).first()[0] == [0.5, -1.0]
