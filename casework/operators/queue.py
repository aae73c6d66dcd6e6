"""Queue views: B1, B2, B5-B8, F2, F4."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions import labels, sla
from casework.operators.store import scan

MAX_LIMIT = 500
SORT_KEYS = {
    "Priority": "priority_score",
    "Date": "date",
    "Risk score": "risk_score",
    "Breach probability": "sla_breach_prob",
}
# --- fixed values: queue columns and their titles -----------------------------------------------------
QUEUE_COLUMNS = (
    ("id", "Complaint ID"),
    ("date", "Date"),
    ("customer_name", "Customer"),
    ("channel", "Channel"),
    ("category_badge", "Category"),
    ("severity", "Severity"),
    ("sentiment_badge", "Sentiment"),
    ("priority_score", "Priority"),
    ("amount_text", "Amount (INR)"),
    ("sla_due_date", "SLA Deadline"),
    ("breach_text", "Breach probability"),
    ("risk_score", "Risk score"),
    ("duplicate_of", "Duplicate of"),
)


def search(cases: DataFrame, limit: int = 50, **equals) -> DataFrame:
    """B1: newest cases matching every given column value; None is no condition."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    out = cases
    for column, value in equals.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return scan(out, limit=limit)


def queue(cases: DataFrame, severities: Sequence[str] = (), categories: Sequence[str] = (),
          channels: Sequence[str] = (), high_risk_only: bool = False, sort_by: str = "Priority",
          limit: int = 60) -> DataFrame:
    """B2: filtered queue, one descending sort key with nulls last, ties by id."""
    out = cases
    for column, values in (("severity", severities), ("category", categories), ("channel", channels)):
        if values:
            out = out.where(F.col(column).isin(*values))
    if high_risk_only:
        out = out.where(F.coalesce("sla_breach_prob", F.lit(0.0)) >= 0.5)
    return out.orderBy(F.col(SORT_KEYS[sort_by]).desc_nulls_last(), "id").limit(limit)


def display(view: DataFrame) -> DataFrame:
    """Badges, formatted values and titles; columns the view lacks are skipped."""
    out = view
    for label in ("category", "sentiment"):
        if label in view.columns:
            confidence = f"{label}_confidence"
            known = F.col(confidence) if confidence in view.columns else F.lit(None).cast("string")
            out = out.withColumn(f"{label}_badge", labels.badge(F.col(label), known))
    if "sla_breach_prob" in view.columns:
        out = out.withColumn("breach_text", labels.percent(F.col("sla_breach_prob")))
    if "amount_involved" in view.columns:
        out = out.withColumn("amount_text", labels.rupees(F.col("amount_involved")))
    return out.select(*[F.col(name).alias(title) for name, title in QUEUE_COLUMNS if name in out.columns])


def unprocessed(cases: DataFrame, limit: int | None = None) -> DataFrame:
    """B6."""
    return scan(cases, F.col("processed_at").isNull(), limit)


def drafted(cases: DataFrame, limit: int = 20) -> DataFrame:
    """B7."""
    return scan(cases, F.col("draft_response").isNotNull(), limit)


def reviewable(cases: DataFrame) -> DataFrame:
    """B8."""
    return scan(cases, F.col("category").isNotNull()).select("id", "date")


def most_urgent(cases: DataFrame, as_of, limit: int = 25) -> DataFrame:
    """F2."""
    days = sla.days_until_due(F.col("sla_due_date"), as_of)
    return (
        cases.where(F.col("sla_due_date").isNotNull())
        .withColumn("days_until_due", days)
        .orderBy("days_until_due", F.col("sla_breach_prob").desc_nulls_last(), "id")
        .limit(limit)
    )


def newest_mail(mails: DataFrame, batch: int = 5) -> DataFrame:
    """the newest mails of one poll."""
    return mails.orderBy(F.col("sent_at").desc(), F.col("mail_id").desc()).limit(batch)
