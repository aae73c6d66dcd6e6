"""Service-level dates, probabilities and report statuses H12-H19, C4."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.schemas import SEVERITY_MULTIPLIER, SLA_DAYS, lookup

# --- fixed values: rule-based breach probability -------------------------------------------------
BREACH_BASE = 0.18
BREACH_BY_SEVERITY = {"Critical": 0.35, "High": 0.20, "Low": -0.08}
BREACH_HIGH_AMOUNT = 25000
BREACH_AMOUNT_STEP = 0.10
BREACH_FLOOR, BREACH_CEILING = 0.02, 0.92
SLA_BUCKETS = ("Overdue", "<1 day", "<3 days", "<7 days", ">7 days")


def day(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def sla_days(category: Column, severity: Column) -> Column:
    """C4 + H15: days allowed, rounded half to even, at least one."""
    base = lookup(category, SLA_DAYS, SLA_DAYS["General"])
    factor = lookup(F.coalesce(severity, F.lit("Medium")), SEVERITY_MULTIPLIER, 1.0)
    return F.greatest(F.lit(1), F.bround(base * factor, 0).cast("int"))


def due_date(filed: Column, category: Column, severity: Column) -> Column:
    """H15."""
    return F.date_add(filed, sla_days(category, severity))


def days_until_due(due: Column, as_of) -> Column:
    """H16."""
    return F.date_diff(due, day(as_of))


def weekday(filed: Column) -> Column:
    """Monday is 0."""
    return F.weekday(filed)


def hours_since(filed: Column, as_of) -> Column:
    """From midnight of the filing date to midnight of `as_of`."""
    return F.date_diff(day(as_of), filed).cast("double") * 24.0


def sla_share_elapsed(hours: Column, days: Column) -> Column:
    """H13."""
    return hours / (days * 24.0)


def breach_rule(severity: Column, amount: Column) -> Column:
    """H17."""
    p = F.lit(BREACH_BASE) + lookup(severity, BREACH_BY_SEVERITY, 0.0)
    p = p + F.when(F.coalesce(amount, F.lit(0.0)) >= BREACH_HIGH_AMOUNT, BREACH_AMOUNT_STEP).otherwise(0.0)
    return F.round(F.greatest(F.lit(BREACH_FLOOR), F.least(F.lit(BREACH_CEILING), p)), 3)


def sla_bucket(days_left: Column) -> Column:
    """D11."""
    return (
        F.when(days_left < 0, SLA_BUCKETS[0])
        .when(days_left <= 1, SLA_BUCKETS[1])
        .when(days_left <= 3, SLA_BUCKETS[2])
        .when(days_left <= 7, SLA_BUCKETS[3])
        .otherwise(SLA_BUCKETS[4])
    )


def breach_status(due: Column, probability: Column, as_of) -> Column:
    """H18."""
    return (
        F.when(due.isNull(), "Unknown")
        .when(due < day(as_of), "Breached")
        .when(probability >= 0.5, "At Risk")
        .otherwise("On Track")
    )


def resolution_status(status: Column, duplicate_of: Column, due: Column, as_of) -> Column:
    """H19, including rows flagged as duplicates before the status existed."""
    state = F.lower(F.coalesce(status, F.lit("open")))
    return (
        F.when(state == "resolved", "Resolved")
        .when(state == "auto_resolved_dup", "Auto-Resolved (Duplicate)")
        .when(state == "auto_resolved_std", "Auto-Resolved (Standard Reply Sent)")
        .when(state == "escalated", "Escalated")
        .when(duplicate_of.isNotNull() & (duplicate_of.cast("string") != ""), "Auto-Resolved (Duplicate)")
        .when(due < day(as_of), "Breached")
        .otherwise("Pending")
    )


def resolution_bucket(status: Column, due: Column, as_of) -> Column:
    """Five display buckets; anything not closed is Breached or Pending."""
    state = F.coalesce(status, F.lit("open"))
    return (
        F.when(state == "resolved", "Resolved")
        .when(state == "auto_resolved_dup", "Auto-Resolved (Dup)")
        .when(state == "auto_resolved_std", "Auto-Resolved (Standard)")
        .when(due < day(as_of), "Breached")
        .otherwise("Pending")
    )
