"""Inbound mail to cases: A4 with the sender block list B12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions import text

# --- fixed values: senders that never file complaints -------------------------------------------------
BLOCKED_SENDERS = (
    "no-reply@accounts.google.com", "noreply@google.com", "no-reply@google.com",
    "googleplay-noreply@google.com", "mail-noreply@google.com", "noreply@youtube.com",
    "noreply@linkedin.com", "noreply@twitter.com", "noreply@x.com", "noreply@facebook.com",
)
BLOCKED_PARTS = (
    "no-reply@", "noreply@", "do-not-reply@", "donotreply@",
    "notifications@", "mailer-daemon@", "postmaster@",
)
DEFAULT_ACCOUNT_TYPE = "savings"
# Characters with the Unicode property White_Space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _strip(column: Column) -> Column:
    return F.btrim(column, F.lit(_SPACE))


def blocked(address: Column) -> Column:
    """B12."""
    lowered = F.lower(F.coalesce(address, F.lit("")))
    hit = lowered.isin(*BLOCKED_SENDERS)
    for part in BLOCKED_PARTS:
        hit = hit | F.contains(lowered, F.lit(part))
    return hit


def tagged(mails: DataFrame) -> DataFrame:
    """Mail with its complaint text and the reason it would be dropped, null when it is kept."""
    body = F.coalesce("body", F.lit(""))
    subject = F.coalesce("subject", F.lit("(no subject)"))
    return (
        mails.withColumn("_subject", subject)
        .withColumn("_body", _strip(body))
        .withColumn(
            "complaint_text",
            _strip(
                F.when(
                    (F.col("_subject") != "") & ~F.contains(F.lower("_body"), F.lower("_subject")),
                    F.concat(F.lit("Subject: "), "_subject", F.lit("\n\n"), "_body"),
                ).otherwise(F.col("_body"))
            ),
        )
        .withColumn(
            "drop_reason",
            F.when(blocked(F.col("from_addr")), "blocked sender").when(F.col("complaint_text") == "", "empty"),
        )
    )


def normalise(mails: DataFrame, as_of, max_chars: int | None = None) -> DataFrame:
    """A4: kept mail as raw cases; a missing send time takes `as_of` as filing date.

    The whole text is the complaint. `max_chars` cuts what is stored, for stores that bound it; nothing here does.
    """
    kept = tagged(mails).where(F.col("drop_reason").isNull())
    kept, scanned = text.scan(kept, "complaint_text")
    kept = kept.withColumn("_search", F.concat_ws(" ", F.lower("_subject"), "_lowered"))
    address = F.coalesce("from_addr", F.lit(""))
    return kept.select(
        "mail_id",
        F.coalesce(F.nullif(_strip(F.coalesce("from_name", F.lit(""))), F.lit("")), F.substring_index(address, "@", 1))
        .alias("customer_name"),
        F.lit("email").alias("channel"),
        (F.col("complaint_text") if max_chars is None else F.substring("complaint_text", 1, max_chars)).alias("complaint_text"),
        text.language_tag(F.col("complaint_text")).alias("language"),
        F.coalesce(F.col("sent_at").cast("date"), F.lit(str(as_of)).cast("date")).alias("date"),
        F.lit(DEFAULT_ACCOUNT_TYPE).alias("account_type"),
        text.amount_from_text(scanned).alias("amount_involved"),
        text.city_tag(F.col("_search")).alias("location"),
        F.col("from_addr").alias("customer_email"),
    )


def drop_counts(mails: DataFrame) -> DataFrame:
    """How many mails each rule keeps out."""
    reason = F.coalesce("drop_reason", F.lit("kept"))
    return tagged(mails).groupBy(reason.alias("outcome")).agg(F.count("*").alias("mails"))
