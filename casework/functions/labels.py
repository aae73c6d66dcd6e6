"""Agreement labels, automatic resolution, reply template and instants: H26-H29, H34."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.schemas import CATEGORIES, HIGH_CONFIDENCE, NEEDS_REVIEW, UNKNOWN, lookup

# --- fixed values: sentiment buckets and the standard reply -----------------------------------------
SENTIMENT_BUCKET = {"Angry": "negative", "Frustrated": "negative", "Neutral": "neutral", "Polite": "positive"}
SCORER_BUCKET = {
    "positive": "positive", "neutral": "neutral", "negative": "negative",
    "LABEL_2": "positive", "LABEL_1": "neutral", "LABEL_0": "negative",
}
REFERENCE_PREFIX = "UBI/"
REPLY_SUBJECT = "Update regarding your complaint %s - Union Bank of India"
REPLY_TEMPLATE = (
    "Dear %s,\n\n"
    "Thank you for contacting Union Bank of India regarding your %s concern. "
    "We have registered your complaint under reference %s and our team will investigate "
    "and resolve it within %d business days. For urgent assistance please call 1800-22-2244.\n\n"
    "Regards,\nUnion Bank Customer Care\n(standard template)"
)


def _present(column: Column) -> Column:
    return column.isNotNull() & (column != "")


def _verdict(known: Column, equal: Column) -> Column:
    return F.when(~known, UNKNOWN).when(equal, HIGH_CONFIDENCE).otherwise(NEEDS_REVIEW)


def category_agreement(assigned: Column, predicted: Column) -> Column:
    """H27."""
    return _verdict(_present(assigned) & _present(predicted), assigned == predicted)


def sentiment_bucket(sentiment: Column) -> Column:
    return lookup(sentiment, SENTIMENT_BUCKET, "neutral")


def scorer_bucket(label: Column) -> Column:
    """Bucket of an external scorer's label; an unlisted label is its own lower-case bucket."""
    return F.coalesce(lookup(label, SCORER_BUCKET), F.lower(label))


def sentiment_agreement(assigned: Column, scored_bucket: Column) -> Column:
    """H28."""
    return _verdict(_present(assigned) & scored_bucket.isNotNull(), sentiment_bucket(assigned) == scored_bucket)


def resolution(is_duplicate: Column, category: Column, severity: Column, sentiment: Column) -> Column:
    """Status after enrichment."""
    standard = severity.isin("Low", "Medium") & (sentiment == "Polite") & category.isin(*CATEGORIES)
    return F.when(is_duplicate, "auto_resolved_dup").when(standard, "auto_resolved_std").otherwise("open")


def standard_reply(case_id: Column, customer_name: Column, category: Column, days: Column) -> Column:
    """Built from the template without a formatter call per row."""
    values = [
        F.coalesce(F.nullif(customer_name, F.lit("")), F.lit("Customer")),
        F.coalesce(category, F.lit("service")),
        F.concat(F.lit(REFERENCE_PREFIX), F.coalesce(case_id.cast("string"), F.lit("NEW"))),
        days.cast("string"),
    ]
    pieces = REPLY_TEMPLATE.replace("%d", "%s").split("%s")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def reply_subject(case_id: Column) -> Column:
    before, after = REPLY_SUBJECT.split("%s")
    return F.concat(F.lit(before), case_id.cast("string"), F.lit(after))


def iso_instant(instant: Column) -> Column:
    """Second precision with a trailing Z; the input is UTC wall-clock time."""
    return F.date_format(instant.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def badge(value: Column, confidence: Column) -> Column:
    """B3."""
    return (
        F.when(value.isNull(), "-")
        .when(confidence == NEEDS_REVIEW, F.concat(value, F.lit(" (*)")))
        .otherwise(value)
    )


def percent(value: Column) -> Column:
    """Whole percent, half to even, `-` when missing."""
    return F.coalesce(F.concat(F.bround(value * 100, 0).cast("long").cast("string"), F.lit("%")), F.lit("-"))


def rupees(amount: Column) -> Column:
    """Grouped whole amount, `-` when missing or zero."""
    return F.when(amount > 0, F.concat(F.lit("Rs "), F.format_number(F.bround(amount, 0), 0))).otherwise("-")
