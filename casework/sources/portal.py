"""Portal and service input: A17 row shaping, A18 input contract, B11 validity split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: input contract ------------------------------------------------------------------
MIN_CHARS = 4
INPUT_DEFAULTS = {
    "customer_name": "Walk-in",
    "channel": "email",
    "language": "english",
    "account_type": "savings",
}


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def portal_amount(raw: Column) -> Column:
    """Leading number of the form value; zero, plain text and NaN become null."""
    number = F.regexp_extract(F.coalesce(raw, F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.nullif(number.try_cast("double"), F.lit(0.0))


def shape_forms(forms: DataFrame) -> DataFrame:
    """Accepted portal posts as raw cases. The id is the whole digest of the post, so a retry keeps its id and no two posts share one."""
    accepted = forms.where(
        _filled("email").isNotNull() & _filled("customer_name").isNotNull() & _filled("complaint_text").isNotNull()
    )
    digest = F.sha2(
        F.concat_ws("\u0001", "email", "customer_name", "complaint_text", F.col("received_at").cast("string")), 256
    )
    return accepted.select(
        F.concat(F.lit("PORTAL-"), F.upper(digest)).alias("id"),
        _filled("account_no").alias("account_no"),
        F.col("email").alias("customer_email"),
        "customer_name",
        F.lit("portal").alias("channel"),
        "complaint_text",
        F.coalesce(_filled("language"), F.lit("English")).alias("language"),
        F.col("received_at").cast("date").alias("date"),
        _filled("location").alias("location"),
        _filled("account_type").alias("account_type"),
        portal_amount(F.col("amount_involved")).alias("amount_involved"),
        F.lit("open").alias("status"),
    )


def check_input(rows: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Defaults filled, and the reason a row breaks the text contract (null when accepted). Texts have no upper bound
    unless `max_chars` gives one."""
    length = F.char_length("complaint_text")
    reason = (
        F.when(F.col("complaint_text").isNull(), "missing text")
        .when(length < MIN_CHARS, "too short")
        .when(F.lit(max_chars is not None) & (length > F.lit(max_chars)), "too long")
    )
    out = rows.withColumn("reason", reason)
    for name, default in INPUT_DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default))
    for name, kind in (("location", "string"), ("amount_involved", "double")):
        if name not in rows.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def split_valid(rows: DataFrame, verdict: str = "is_valid") -> tuple[DataFrame, DataFrame]:
    """Rows to ingest and strikes to record; an unreadable verdict counts as valid."""
    ok = F.coalesce(F.col(verdict), F.lit(True))
    return rows.where(ok), rows.where(~ok).select(F.col("account_no").alias("account_number"), "created_at")
