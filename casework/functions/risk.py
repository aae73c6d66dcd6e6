"""Customer risk H21-H24, priority H25, ordinal scales H14, tiers B9 and emotion rank B10."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.schemas import PUBLIC_CHANNELS, lookup

# --- fixed values: weights and scales ------------------------------------------------------------
RISK_WEIGHTS = {"ombudsman": 0.45, "churn": 0.30, "social": 0.25}
SEVERITY_POINTS = {"Critical": 30, "High": 20, "Medium": 10, "Low": 3}
SLA_SEVERITY_SCALE = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
SLA_SENTIMENT_SCALE = {"Angry": 4, "Frustrated": 3, "Neutral": 2, "Polite": 1}
PRIORITY_SEVERITY_SCALE = {"Critical": 3, "High": 2, "Medium": 1, "Low": 0}
PRIORITY_SENTIMENT_SCALE = {"Angry": 3, "Frustrated": 2, "Neutral": 1, "Polite": 0}
EMOTION_RANK = {"Polite": 1, "Neutral": 2, "Frustrated": 3, "Angry": 4}
UPSET = ("Angry", "Frustrated")
DEFAULT_BREACH = 0.3


def _capped(value: Column, cap: int) -> Column:
    return F.least(value, F.lit(cap))


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def ombudsman(probability, severity, amount, filed, upset) -> Column:
    """H21; `filed` and `upset` are counts over the customer's history."""
    money = F.coalesce(amount, F.lit(0.0))
    return (
        F.bround(F.coalesce(probability, F.lit(0.0)) * 40, 0).cast("int")
        + lookup(F.coalesce(F.nullif(severity, F.lit("")), F.lit("Medium")), SEVERITY_POINTS, 10)
        + _capped(filed * 3, 15)
        + F.when(money >= 100000, 12).when(money >= 25000, 6).otherwise(0)
        + _capped(upset * 2, 8)
    ).cast("int")


def churn(severity, sentiment, filed, unresolved, categories) -> Column:
    """H22."""
    return (
        _capped(filed * 6, 30)
        + _capped(unresolved * 5, 25)
        + _capped(categories * 6, 20)
        + _points(sentiment.isin(*UPSET), 12)
        + _points(severity.isin("Critical", "High"), 8)
    ).cast("int")


def social(severity, sentiment, channel, public) -> Column:
    """H23."""
    return (
        _capped(public * 12, 45)
        + _points(channel.isin(*PUBLIC_CHANNELS), 18)
        + F.when(sentiment == "Angry", 22).when(sentiment == "Frustrated", 10).otherwise(0)
        + _points(severity == "Critical", 8)
    ).cast("int")


def clipped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def overall(ombudsman_score, churn_score, social_score) -> Column:
    """Mix of the unclipped sub-scores, rounded half to even, then clipped."""
    mix = (
        F.lit(RISK_WEIGHTS["ombudsman"]) * ombudsman_score
        + F.lit(RISK_WEIGHTS["churn"]) * churn_score
        + F.lit(RISK_WEIGHTS["social"]) * social_score
    )
    return clipped(F.bround(mix, 0).cast("int"))


def priority_composite(severity, sentiment, amount, complaints, days_since, is_duplicate, probability) -> Column:
    """H25 as an unrounded 0..100 double; a null count or age counts as one and zero."""
    score = (
        lookup(severity, PRIORITY_SEVERITY_SCALE, 1) * 12
        + lookup(sentiment, PRIORITY_SENTIMENT_SCALE, 1) * 7
        + F.greatest(F.lit(0.0), F.least(F.coalesce(amount, F.lit(0.0)) / 5000.0, F.lit(20.0)))
        + F.greatest(F.lit(0), F.least(F.greatest(F.lit(1), F.coalesce(complaints, F.lit(1))) * 3, F.lit(12)))
        + F.greatest(F.lit(0.0), F.least(F.coalesce(days_since, F.lit(0)) * F.lit(0.4), F.lit(10.0)))
        + F.coalesce(probability, F.lit(DEFAULT_BREACH)) * 18
        - is_duplicate * 8
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def risk_tier(score: Column) -> Column:
    """Display tier; a missing score counts as Medium."""
    return F.when(score.isNull(), "Medium").when(score >= 70, "Critical").when(score >= 40, "High").otherwise("Low")


def emotion_rank(sentiment: Column) -> Column:
    """B10."""
    return lookup(sentiment, EMOTION_RANK, 0)
