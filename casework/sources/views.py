"""Case views over the order tables, built so that unused joins never run.

Customer and nation are looked up with left joins on their unique keys, so leaving a join out changes no
row. `cases` joins only what the requested columns need; everything else is a projection of the order scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.functions import sla
from casework.schemas import ACCOUNT_TYPES, CATEGORIES, CHANNELS, LANGUAGES, SENTIMENTS

AS_OF = "2001-08-01"
_CUSTOMER_COLUMNS = {"customer_name", "location", "account_no", "customer_email"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values, key):
    chain = F.when(key == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        chain = chain.when(key == i, value)
    return chain


def cases(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The case table; name the columns you need to skip the joins you do not need."""
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "O", "open")
        .when(F.col("o_orderstatus") == "F", "resolved")
        .otherwise(_pick(("auto_resolved_dup", "auto_resolved_std", "escalated"), key % 3))
    )
    age = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 92
    out = orders.select(
        key.alias("id"),
        F.col("o_custkey"),
        F.date_add(F.lit("2001-05-01").cast("date"), age).alias("date"),
        F.when(key % 11 != 0, F.col("o_totalprice") / 4).alias("amount_involved"),
        _pick(CHANNELS, key % 7).alias("channel"),
        _pick(LANGUAGES, key % 3).alias("language"),
        _pick(ACCOUNT_TYPES, key % 5).alias("account_type"),
        F.when(key % 13 != 0, _pick(CATEGORIES, key % 6)).alias("category"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "High")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium")
        .when(F.col("o_orderpriority") == "5-LOW", "Low")
        .alias("severity"),
        _pick(SENTIMENTS, key % 5).alias("sentiment"),
        status.alias("status"),
    )
    out = out.select(
        "*",
        F.when(F.col("status") != "open", F.date_add("date", (F.col("id") % 40).cast("int"))).alias("resolved_at"),
        F.when(F.col("status") == "auto_resolved_dup", F.col("id") - 1).alias("duplicate_of"),
        F.when(F.col("id") % 17 != 0, F.col("date")).alias("processed_at"),
        sla.due_date(F.col("date"), F.col("category"), F.col("severity")).alias("sla_due_date"),
        F.when(F.col("id") % 17 != 0, (F.col("id") * 37 % 101).cast("double") / 100).alias("sla_breach_prob"),
        (F.col("id") * 29 % 101).cast("int").alias("risk_score"),
        (F.col("id") * 53 % 101).cast("int").alias("priority_score"),
        F.when(F.col("id") % 4 <= 1, "High Confidence").when(F.col("id") % 4 == 2, "Needs Review")
        .alias("category_confidence"),
    )
    if not columns or _CUSTOMER_COLUMNS & set(columns):
        customer = table(spark, folder, "customer").select(
            "c_custkey", F.col("c_name").alias("customer_name"), "c_nationkey"
        )
        out = out.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn(
            "account_no", F.col("o_custkey").cast("string")
        )
        out = out.withColumn(
            "customer_email",
            F.when(F.col("id") % 4 == 0, F.concat(F.lower("customer_name"), F.lit("@example.com"))),
        )
        if not columns or "location" in columns:
            nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
            out = out.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn(
                "location", F.concat(F.col("n_name"), F.lit("#"), (F.col("c_custkey") % 40).cast("string"))
            )
    kept = columns or [c for c in out.columns if c not in ("o_custkey", "c_custkey", "c_nationkey", "n_nationkey", "n_name")]
    return out.select(*kept)


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Portal accounts: every second customer has one."""
    customer = table(spark, folder, "customer").where(F.col("c_custkey") % 2 == 0)
    return customer.select(
        F.col("c_custkey").cast("string").alias("account_no"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("email"),
    )


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("complaint_text"),
        F.col("lang").alias("language"),
        F.col("source").alias("channel"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as indexed cases: the label names the customer and, through six values, the category."""
    key = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        key.alias("id"),
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("customer_name"),
        F.when(key % 19 != 0, _pick(CATEGORIES, F.col("label") % 6)).alias("category"),
        F.when(key % 7 != 0, F.concat(F.lit("city"), (key % 9).cast("string"))).alias("location"),
        "embedding",
    )


def filed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Unlabelled cases with their text and vector, as the enrichment job receives them."""
    base = cases(
        spark, folder, "id", "customer_name", "channel", "language", "account_type", "date",
        "amount_involved", "location", "customer_email",
    )
    text = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("complaint_text"))
    vector = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return base.join(text, "id", "left").join(vector, "id", "left")


def strikes(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where(F.col("event_type") == "error")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("account_number"),
        F.col("ts").alias("created_at"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("client"), F.col("ts").alias("at")
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as human feedback: two reviewed fields per document, with repeated reviews."""
    labels = table(spark, folder, "labels")
    key = F.col("doc_id")
    category = labels.select(
        (key * 2).alias("id"), key.alias("complaint_id"), F.lit("category").alias("field"),
        _pick(CATEGORIES, key % 6).alias("original_value"),
        F.when(F.col("quality") == 0, _pick(CATEGORIES, (key + 1) % 6)).alias("corrected_value"),
        (F.col("quality") == 1).alias("is_correct"),
    )
    severity = labels.select(
        (key * 2 + 1).alias("id"), (key - key % 3).alias("complaint_id"), F.lit("severity").alias("field"),
        F.lit("Medium").alias("original_value"),
        F.when(F.col("toxic") == 1, "High").when(key % 2 == 0, "Low").alias("corrected_value"),
        ((F.col("toxic") == 0) & (key % 2 == 1)).alias("is_correct"),
    )
    both = category.unionByName(severity)
    stamp = F.timestamp_add("SECOND", (F.col("id") % 50).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return both.withColumn("created_at", stamp)


def mails(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as decoded inbound mail; every eleventh sender is an automatic mailer."""
    key = F.col("doc_id")
    text = F.col("text")
    sender = (
        F.when(key % 11 == 0, F.concat(F.lit("No-Reply@"), F.col("source"), F.lit(".example.com")))
        .when(key % 13 == 0, F.lit("noreply@x.com"))
        .otherwise(F.concat(F.lit("User"), key.cast("string"), F.lit("@"), F.col("source"), F.lit(".example.com")))
    )
    return table(spark, folder, "documents").select(
        key.cast("string").alias("mail_id"),
        F.when(key % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Person "), key.cast("string"))).alias("from_name"),
        sender.alias("from_addr"),
        F.when(key % 5 == 0, F.substring(text, 3, 12)).otherwise(F.concat(F.lit("Case about Nagpur "), key.cast("string")))
        .alias("subject"),
        F.when(key % 17 == 0, F.concat(F.lit("Rs 1,"), (key % 900 + 100).cast("string"), F.lit(".50 lost. "), text))
        .otherwise(text).alias("body"),
        F.timestamp_add("HOUR", (key % 700).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("sent_at"),
    )


def portal_forms(spark: SparkSession, folder: str) -> DataFrame:
    """First turns of conversations as portal form posts with missing and unreadable fields."""
    talk = table(spark, folder, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    return talk.select(
        F.when(key % 5 != 0, F.concat(F.lit("c"), key.cast("string"), F.lit("@example.org"))).alias("email"),
        F.concat(F.lit("Client "), F.col("conv_id").cast("string")).alias("customer_name"),
        F.when(key % 7 != 0, F.col("text")).otherwise("").alias("complaint_text"),
        F.when(key % 2 == 0, key.cast("string")).alias("account_no"),
        F.lit(None).cast("string").alias("language"),
        F.when(key % 3 == 0, "Pune").alias("location"),
        F.lit("").alias("account_type"),
        F.when(key % 4 == 0, "abc").when(key % 4 == 1, "NaN").when(key % 4 == 2, "0").otherwise(key.cast("string"))
        .alias("amount_involved"),
        F.timestamp_add("MINUTE", (key % 1000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("received_at"),
    )
