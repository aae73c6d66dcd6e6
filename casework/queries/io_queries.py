"""Sources and sinks: each query writes a driver table through a sink and reads the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casework import schemas
from casework.functions import text
from casework.models import vectoriser
from casework.operators import duplicates, kpi, rootcause, store, strikes
from casework.queries.base import VECTORS, over, query
from casework.queries.report_queries import REPORT_SQL, compliance_report
from casework.queries.text_queries import KEYWORD_SQL, MAILS, SENTIMENT_SQL
from casework.queries.vector_queries import CLUSTERED, _labelled
from casework.session import ensure_checkpoint_dir
from casework.sources import dims, files, portal, views
from casework.sources.views import AS_OF, table
from casework.streaming import intake


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/io-{uuid.uuid4().hex}"


@query("a1_seed_json", """
SELECT CAST(doc_id AS VARCHAR) AS id, text AS complaint_text, DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS date, lang AS language
FROM documents""")
def seed_json(spark, folder):
    """Documents written as JSON lines, read with the raw schema and conformed."""
    path = scratch(spark)
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("complaint_text"), F.col("lang").alias("language"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("string").alias("date"),
    )
    docs.write.json(path)
    loaded = schemas.conform(files.read_seed_json(spark, path, lines=True), schemas.CASE)
    return loaded.select("id", "complaint_text", "date", "language")


_TEXT_COLUMNS = ("Complaint ID", "Date Filed", "SLA Deadline", "Days Remaining")


@query("a7_report_csv", f"""
SELECT * REPLACE ({", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in _TEXT_COLUMNS)}) FROM ({REPORT_SQL})""")
def report_csv(spark, folder):
    """A7 and the dated folder of A19."""
    report = compliance_report(spark, folder)
    path = files.write_report_csv(report, scratch(spark), AS_OF)
    schema = ", ".join(f"`{c}` string" for c in report.columns)
    return spark.read.schema(schema).option("header", True).csv(path)


@query("a19_report_json", REPORT_SQL)
def report_json(spark, folder):
    from casework.operators.report import summary

    report = compliance_report(spark, folder)
    totals = summary(views.cases(spark, folder, "status", "sla_due_date"), AS_OF)
    path = files.write_report_json(report, totals, scratch(spark), AS_OF)
    return spark.read.schema(report.schema).json(f"{path}/rows")


@query("a9_alert_table", over(VECTORS, CLUSTERED) + """
SELECT ROW_NUMBER() OVER (ORDER BY count DESC, rounded DESC, cluster_id) AS id, cluster_id, category, count
FROM (SELECT *, round(category_share, 2) AS rounded FROM prof WHERE count >= 5 AND category_share >= 0.6) ORDER BY 1 DESC LIMIT 20""")
def alert_table(spark, folder):
    """The alert table is written and its latest rows are read back."""
    path = scratch(spark)
    found = rootcause.numbered(rootcause.alerts(_labelled(spark, folder)), "2001-08-01 00:00:00")
    store.replace_alerts(found, path)
    return store.latest_alerts(spark.read.schema(found.schema).parquet(path)).select("id", "cluster_id", "category", "count")


@query("a11_recorded_strikes", """
SELECT CAST(user_id AS VARCHAR) AS account_number, COUNT(*) AS strikes FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1""")
def recorded_strikes(spark, folder):
    """Signups stand for newly rejected requests."""
    invalid = table(spark, folder, "events").where(F.col("event_type") == "signup").select(
        F.col("user_id").cast("string").alias("account_number")
    )
    both = strikes.record(views.strikes(spark, folder), invalid, "2024-02-01 00:00:00")
    return both.groupBy("account_number").agg(F.count("*").alias("strikes"))


CITIES_SQL = ", ".join(f"('{name}', {lat}::DOUBLE, {lon}::DOUBLE)" for name, (lat, lon) in dims.CITY_COORDINATES.items())


@query("a13_city_dimension", f"""
SELECT location, COUNT(*) AS cases, lat, lon FROM (SELECT DISTINCT * FROM (VALUES {CITIES_SQL}) c(location, lat, lon)) JOIN
  (SELECT list_element([{", ".join(f"'{c}'" for c in dims.CITY_COORDINATES)}, 'Nowhere'], CAST(doc_id % {len(dims.CITY_COORDINATES) + 1} AS INTEGER) + 1) AS location
   FROM documents) USING (location) GROUP BY 1, 3, 4""")
def city_dimension(spark, folder):
    """Every city of the dimension, and one that it lacks, placed on the map."""
    names = F.array(*[F.lit(c) for c in dims.CITY_COORDINATES], F.lit("Nowhere"))
    place = (F.col("doc_id") % (len(dims.CITY_COORDINATES) + 1) + 1).cast("int")
    docs = table(spark, folder, "documents").select(F.element_at(names, place).alias("location"))
    return kpi.mapped_cities(docs, dims.city_coordinates(spark)).select("location", "cases", "lat", "lon")


@query("b11_validity_split", """
SELECT CASE WHEN conv_id % 3 = 0 THEN 'strike' ELSE 'kept' END AS outcome, COUNT(*) AS rows FROM conversations GROUP BY 1""")
def validity_split(spark, folder):
    """Verdicts of false, true and unreadable."""
    key = F.col("conv_id") % 3
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("account_no"), F.when(key == 0, False).when(key == 1, True).alias("is_valid"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )
    kept, struck = portal.split_valid(rows)
    outcomes = kept.select(F.lit("kept").alias("outcome")).unionByName(struck.select(F.lit("strike").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("rows"))


@query("j1_text_vectors", "SELECT doc_id AS id, 64 AS dims, 1.0::DOUBLE AS length FROM documents")
def text_vectors(spark, folder):
    """Hashed TF-IDF vectors of whole documents have unit length."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    made = duplicates.text_vectors(docs, "text", 64)
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return made.select("id", F.size("embedding").alias("dims"), F.round(F.sqrt(square), 4).alias("length"))


@query("j1_stored_vectoriser", """
SELECT doc_id AS id, (SELECT COUNT(*) FROM documents) AS texts, 384 AS dims,
  CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}_]') THEN 1.0::DOUBLE ELSE 0 END AS length FROM documents""")
def stored_vectoriser(spark, folder):
    """Document frequencies of two halves added up, kept, read again and applied to all documents."""
    docs = table(spark, folder, "documents")
    halves = [vectoriser.counts(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == i), "text") for i in range(2)]
    path = f"{scratch(spark)}/vectoriser"
    vectoriser.TextVectoriser.of(vectoriser.merged(*halves)).save(spark, path)
    fitted = vectoriser.TextVectoriser.load(spark, path)
    made = docs.select(F.col("doc_id").alias("id"), fitted(F.col("text")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return made.select("id", F.lit(fitted.texts).cast("long").alias("texts"), F.size("v").alias("dims"), F.round(F.sqrt(square), 4).alias("length"))


_MAIL_SEVERITY = r"""CASE WHEN amount >= 50000 THEN 'Critical' WHEN regexp_matches(text, '(?i)unauthor|fraud|stuck|debit.{0,15}fail|debited') THEN 'High'
  WHEN amount > 0 THEN 'Medium' ELSE 'Low' END"""


@query("i1_mail_ingest", over(MAILS) + rf""",
kept AS (SELECT mail_id AS id, trim(t, E' \n\t\r') AS text, COALESCE(
    TRY_CAST(replace(regexp_extract(t, '(?i)(?:Rs\.?|₹|INR)\s*([0-9,]+(?:\.[0-9]{{1,2}})?)', 1), ',', '') AS DOUBLE),
    TRY_CAST(replace(regexp_extract(t, '(?i)([0-9,]+(?:\.[0-9]{{1,2}})?)\s*(?:rupees?|/-)', 1), ',', '') AS DOUBLE)) AS amount
  FROM judged WHERE drop_reason IS NULL)
SELECT id, {KEYWORD_SQL} AS category, {_MAIL_SEVERITY} AS severity, {SENTIMENT_SQL} AS sentiment, length(text) AS chars FROM kept""")
def mail_ingest(spark, folder):
    """Mail files through the ingest stream, in two triggers, into the enriched case table."""
    base = scratch(spark)
    views.mails(spark, folder).repartition(8, "mail_id").write.json(f"{base}/inbox")
    source = intake.mail_source(spark, f"{base}/inbox", files_per_trigger=4)
    stream = intake.start_mail_ingest(
        source, f"{base}/table", f"{base}/quarantine", f"{base}/checkpoint", "2024-02-01", {"availableNow": True}
    )
    stream.awaitTermination()
    return intake.read_table(spark, f"{base}/table").select("id", "category", "severity", "sentiment", F.char_length("complaint_text").alias("chars"))
