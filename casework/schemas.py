"""Tables, closed vocabularies and rule values of the case model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: closed vocabularies, in their natural order ---------------------------------
CATEGORIES = ("UPI", "ATM", "Card", "Loan", "NetBanking", "General")
SEVERITIES = ("Critical", "High", "Medium", "Low")
SENTIMENTS = ("Angry", "Frustrated", "Neutral", "Polite")
STATUSES = ("open", "resolved", "escalated", "auto_resolved_dup", "auto_resolved_std")
CHANNELS = ("email", "whatsapp", "twitter", "branch", "bank_portal", "phone_call", "mobile_app")
LANGUAGES = ("english", "hindi", "marathi")
ACCOUNT_TYPES = ("savings", "current", "credit_card", "loan", "demat")
AUTO_RESOLVED = ("auto_resolved_dup", "auto_resolved_std")
PUBLIC_CHANNELS = ("twitter", "whatsapp")
HIGH_CONFIDENCE = "High Confidence"
NEEDS_REVIEW = "Needs Review"
UNKNOWN = "Unknown"

# --- fixed values: service-level rules ----------------------------------------------------------
SLA_DAYS = {"UPI": 5, "ATM": 5, "Card": 7, "NetBanking": 7, "Loan": 30, "General": 30}
SEVERITY_MULTIPLIER = {"Critical": 0.5, "High": 0.7, "Medium": 1.0, "Low": 1.2}

# --- fixed values: columns a patch may write ----------------------------------------------------
UPDATABLE = (
    "date", "channel", "complaint_text",
    "category", "severity", "sentiment", "intake_json",
    "account_no", "customer_email", "duplicate_of", "similarity", "draft_response",
    "sla_due_date", "sla_breach_prob", "risk_score",
    "risk_ombudsman", "risk_churn", "risk_social",
    "cluster_id", "status", "resolved_at", "processed_at",
    "ml_category", "ml_category_prob", "category_confidence",
    "ml_sentiment", "ml_sentiment_prob", "sentiment_confidence",
    "priority_score",
)


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<float>": T.ArrayType(T.FloatType()),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """`name type, ...` as a StructType, usable before any session exists."""
    fields = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


RAW_CASE = _struct(
    "id string, account_no string, customer_email string, customer_name string, channel string, "
    "complaint_text string, language string, date string, location string, account_type string, "
    "amount_involved double"
)

CASE = _struct(
    "id string, account_no string, customer_email string, customer_name string, channel string, "
    "complaint_text string, language string, date date, location string, account_type string, "
    "amount_involved double, category string, severity string, sentiment string, intake_json string, "
    "duplicate_of string, similarity double, draft_response string, sla_due_date date, "
    "sla_breach_prob double, risk_score int, risk_ombudsman int, risk_churn int, risk_social int, "
    "cluster_id int, status string, processed_at timestamp_ntz, resolved_at timestamp_ntz, "
    "ml_category string, ml_category_prob double, category_confidence string, ml_sentiment string, "
    "ml_sentiment_prob double, sentiment_confidence string, priority_score int, embedding array<float>"
)
USERS = _struct("account_no string, name string, email string")
BANK_CUSTOMERS = _struct("account_number string, customer_name string")
ALERTS = _struct(
    "cluster_id int, category string, location string, count bigint, summary string, created_at timestamp_ntz"
)
FEEDBACK = _struct(
    "id bigint, complaint_id string, field string, original_value string, corrected_value string, "
    "is_correct boolean, created_at timestamp_ntz"
)
STRIKES = _struct("id bigint, account_number string, created_at timestamp_ntz")
INTAKE = _struct(
    "customer_name string, issue_summary string, account_type string, amount_involved double, "
    "transaction_id string, location_mentioned string, urgency_keywords array<string>, "
    "detected_language string"
)
MAIL = _struct("mail_id string, from_name string, from_addr string, subject string, body string, sent_at timestamp_ntz")
PORTAL = _struct(
    "email string, customer_name string, complaint_text string, account_no string, language string, "
    "location string, account_type string, amount_involved string, received_at timestamp_ntz"
)


def lookup(column: Column, values: dict, default=None) -> Column:
    """Small fixed dictionary as a CASE chain: stays inside codegen and needs no join."""
    items = list(values.items())
    chain = F.when(column == F.lit(items[0][0]), F.lit(items[0][1]))
    for key, value in items[1:]:
        chain = chain.when(column == F.lit(key), F.lit(value))
    return chain.otherwise(F.lit(default))


def parse_instant(column: Column) -> Column:
    """Text date or ISO instant as a UTC wall-clock timestamp; anything else becomes null."""
    return column.try_cast("timestamp_ntz")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a frame to a schema; missing columns are typed nulls, unreadable values null."""
    present = set(df.columns)
    out = []
    for field in schema.fields:
        if field.name not in present:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        source = df.schema[field.name].dataType
        column = F.col(f"`{field.name}`")
        if source == field.dataType:
            out.append(column.alias(field.name))
        elif isinstance(source, T.StringType) and isinstance(field.dataType, T.DateType):
            out.append(parse_instant(column).cast("date").alias(field.name))
        else:
            out.append(column.try_cast(field.dataType).alias(field.name))
    return df.select(*out)
