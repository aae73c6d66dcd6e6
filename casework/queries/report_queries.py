"""Compliance report and KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.functions import labels, risk, sla
from casework.operators import history, kpi, queue, report, rootcause, store
from casework.queries.base import CASES, VECTORS, over, query
from casework.queries.vector_queries import CLUSTERED, _labelled
from casework.sources import dims, views
from casework.sources.views import AS_OF, cases

REPORT_SQL = over(CASES) + """
SELECT id AS "Complaint ID", customer_name AS "Customer Name", COALESCE(category, 'General') AS "Type",
  COALESCE(severity, 'Medium') AS "Severity", channel AS "Channel", date AS "Date Filed", sla_due_date AS "SLA Deadline",
  CAST(sla_due_date - DATE '2001-08-01' AS INTEGER) AS "Days Remaining",
  CASE WHEN sla_due_date IS NULL THEN 'Unknown' WHEN sla_due_date < DATE '2001-08-01' THEN 'Breached'
    WHEN sla_breach_prob >= 0.5 THEN 'At Risk' ELSE 'On Track' END AS "Breach Status",
  CASE status WHEN 'resolved' THEN 'Resolved' WHEN 'auto_resolved_dup' THEN 'Auto-Resolved (Duplicate)'
    WHEN 'auto_resolved_std' THEN 'Auto-Resolved (Standard Reply Sent)' WHEN 'escalated' THEN 'Escalated'
    ELSE CASE WHEN duplicate_of IS NOT NULL THEN 'Auto-Resolved (Duplicate)'
      WHEN sla_due_date < DATE '2001-08-01' THEN 'Breached' ELSE 'Pending' END END AS "Resolution Status"
FROM cases"""


@query("l5_compliance_report", REPORT_SQL)
def compliance_report(spark, folder):
    """H18, H19 and H20."""
    wanted = ("id", "customer_name", "category", "severity", "channel", "date", "sla_due_date", "sla_breach_prob",
              "status", "duplicate_of")
    return report.compliance_report(cases(spark, folder, *wanted), AS_OF)


@query("d13_report_summary", over(CASES) + """
SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'resolved') AS resolved,
  COUNT(*) FILTER (status IN ('auto_resolved_dup', 'auto_resolved_std')) AS auto_resolved,
  COUNT(*) FILTER (status = 'open' AND sla_due_date >= DATE '2001-08-01') AS pending,
  COUNT(*) FILTER (status = 'open' AND sla_due_date < DATE '2001-08-01') AS breached
FROM cases""")
def report_summary(spark, folder):
    return report.summary(cases(spark, folder, "status", "sla_due_date"), AS_OF)


@query("d13_report_by_category", over(CASES) + """
SELECT COALESCE(category, 'General') AS category, COUNT(*) AS cases FROM cases GROUP BY 1""")
def report_by_category(spark, folder):
    return report.summary_by_category(cases(spark, folder, "category"))


@query("d1_service_stats", over(CASES, VECTORS, CLUSTERED) + """
SELECT 'total' AS metric, '' AS key, CAST(COUNT(*) AS DOUBLE) AS value FROM cases
UNION ALL SELECT 'processed', '', COUNT(processed_at) FROM cases
UNION ALL SELECT 'pending', '', COUNT(*) - COUNT(processed_at) FROM cases
UNION ALL SELECT 'at_risk', '', COUNT(*) FILTER (sla_breach_prob >= 0.5) FROM cases
UNION ALL SELECT 'duplicates', '', COUNT(duplicate_of) FROM cases
UNION ALL SELECT 'avg_breach_probability', '', round(AVG(sla_breach_prob), 3) FROM cases
UNION ALL SELECT 'avg_risk_score', '', round(AVG(risk_score), 1) FROM cases
UNION ALL SELECT 'by_category', COALESCE(category, 'Unprocessed'), COUNT(*) FROM cases GROUP BY 2
UNION ALL SELECT 'by_severity', COALESCE(severity, 'Unprocessed'), COUNT(*) FROM cases GROUP BY 2
UNION ALL SELECT 'by_channel', channel, COUNT(*) FROM cases GROUP BY 2
UNION ALL SELECT 'root_cause_alerts', '', COUNT(*) FROM prof WHERE count >= 5 AND category_share >= 0.6""")
def service_stats(spark, folder):
    wanted = ("category", "severity", "channel", "processed_at", "sla_breach_prob", "risk_score", "duplicate_of")
    return kpi.service_stats(cases(spark, folder, *wanted), rootcause.alerts(_labelled(spark, folder)))


@query("d2_kpi_strip", over(CASES) + """
SELECT COUNT(*) AS total, COUNT(processed_at) AS processed,
  COUNT(*) FILTER (status = 'open' AND sla_breach_prob >= 0.5) AS at_risk,
  COUNT(*) FILTER (status IN ('auto_resolved_dup', 'auto_resolved_std')) AS auto_resolved,
  round(AVG(sla_breach_prob) FILTER (status = 'open'), 4) AS avg_breach
FROM cases""")
def kpi_strip(spark, folder):
    return kpi.kpi_strip(cases(spark, folder, "status", "processed_at", "sla_breach_prob"))


@query("d3_per_day", over(CASES) + "SELECT date, COUNT(*) AS cases FROM cases GROUP BY 1")
def per_day(spark, folder):
    return kpi.per_day(cases(spark, folder, "date"))


def _share_sql(key: str, name: str) -> str:
    return over(CASES) + f"""
SELECT {name}, cases, round(share, 4) AS share,
  CASE WHEN share >= 0.10 THEN {name} || ' ' || CAST(CAST(round_even(share * 100, 0) AS BIGINT) AS VARCHAR) || '%' ELSE '' END AS label
FROM (SELECT {name}, cases, CAST(cases AS DOUBLE) / CAST(SUM(cases) OVER () AS DOUBLE) AS share
  FROM (SELECT {key} AS {name}, COUNT(*) AS cases FROM cases GROUP BY 1))"""


@query("d4_by_category", _share_sql("COALESCE(category, 'Unknown')", "category"))
def by_category(spark, folder):
    return kpi.by_category(cases(spark, folder, "category"))


@query("d5_by_channel", over(CASES) + """
SELECT COALESCE(channel, 'Unknown') AS channel, COUNT(*) AS cases FROM cases GROUP BY 1 ORDER BY 2, 1""")
def by_channel(spark, folder):
    return kpi.by_channel(cases(spark, folder, "channel"))


@query("d6_by_sentiment", _share_sql("COALESCE(sentiment, 'Unknown')", "sentiment"))
def by_sentiment(spark, folder):
    return kpi.by_sentiment(cases(spark, folder, "sentiment"))


@query("d7_by_severity", over(CASES) + """
SELECT severity, COUNT(*) AS cases,
  CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END AS position
FROM cases WHERE severity IS NOT NULL GROUP BY severity ORDER BY position, severity""")
def by_severity(spark, folder):
    return kpi.by_severity(cases(spark, folder, "severity"))


@query("d8_breach_by_category", over(CASES) + """
SELECT category, round(AVG(sla_breach_prob), 4) AS avg_breach FROM cases
WHERE category IS NOT NULL AND sla_breach_prob IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1""")
def breach_by_category(spark, folder):
    return kpi.breach_by_category(cases(spark, folder, "category", "sla_breach_prob"))


@query("d9_top_cities", over(CASES) + """
SELECT COALESCE(location, 'Unknown') AS city, COUNT(*) AS cases FROM cases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_cities(spark, folder):
    return kpi.top_cities(cases(spark, folder, "location"))


@query("d10_resolution_breakdown", _share_sql(
    "CASE status WHEN 'resolved' THEN 'Resolved' WHEN 'auto_resolved_dup' THEN 'Auto-Resolved (Dup)' "
    "WHEN 'auto_resolved_std' THEN 'Auto-Resolved (Standard)' ELSE CASE WHEN sla_due_date < DATE '2001-08-01' "
    "THEN 'Breached' ELSE 'Pending' END END", "bucket"))
def resolution_breakdown(spark, folder):
    return kpi.resolution_breakdown(cases(spark, folder, "status", "sla_due_date"), AS_OF)


@query("d11_sla_histogram", over(CASES) + """
SELECT position, bucket, COUNT(d) AS cases FROM (VALUES (0, 'Overdue'), (1, '<1 day'), (2, '<3 days'), (3, '<7 days'), (4, '>7 days'))
  AS b(position, bucket) LEFT JOIN (SELECT sla_due_date - DATE '2001-08-01' AS d FROM cases WHERE sla_due_date IS NOT NULL)
  ON position = CASE WHEN d < 0 THEN 0 WHEN d <= 1 THEN 1 WHEN d <= 3 THEN 2 WHEN d <= 7 THEN 3 ELSE 4 END
GROUP BY 1, 2""")
def sla_histogram(spark, folder):
    return kpi.sla_histogram(cases(spark, folder, "sla_due_date"), AS_OF)


CITY_SQL = over(CASES) + """
SELECT location, cases, CASE WHEN cases >= 30 THEN 'Very high (30+)' WHEN cases >= 15 THEN 'High (15-29)'
  WHEN cases >= 5 THEN 'Moderate (5-14)' ELSE 'Other (<5)' END AS tier,
  CAST(LEAST(cases * 0.75 + 7, 28) AS DOUBLE) AS marker_size
FROM (SELECT location, COUNT(*) AS cases FROM cases WHERE location IS NOT NULL GROUP BY 1)"""


@query("d12_city_volume", CITY_SQL)
def city_volume(spark, folder):
    return kpi.city_volume(cases(spark, folder, "location"))


@query("d12_labelled_cities", CITY_SQL + " ORDER BY cases DESC, location LIMIT 4")
def labelled_cities(spark, folder):
    return kpi.labelled_cities(cases(spark, folder, "location"))


@query("c5_mapped_cities", over(CASES) + """
SELECT location, cases, CASE WHEN cases >= 30 THEN 'Very high (30+)' WHEN cases >= 15 THEN 'High (15-29)'
  WHEN cases >= 5 THEN 'Moderate (5-14)' ELSE 'Other (<5)' END AS tier,
  CAST(LEAST(cases * 0.75 + 7, 28) AS DOUBLE) AS marker_size, lat, lon
FROM (SELECT split_part(location, '#', 1) AS location, COUNT(*) AS cases FROM cases GROUP BY 1)
JOIN (SELECT n_name, CAST(n_nationkey AS DOUBLE) AS lat, CAST(n_regionkey AS DOUBLE) AS lon FROM nation WHERE n_nationkey < 20)
  ON location = n_name""")
def mapped_cities(spark, folder):
    """The nation table stands in for the city dimension; five nations have no coordinates."""
    where = views.table(spark, folder, "nation").where("n_nationkey < 20").select(
        F.col("n_name").alias("location"), F.col("n_nationkey").cast("double").alias("lat"),
        F.col("n_regionkey").cast("double").alias("lon"),
    )
    placed = cases(spark, folder, "location").select(F.substring_index("location", "#", 1).alias("location"))
    return kpi.mapped_cities(placed, where)


@query("d16_alert_conditions", over(CASES) + """
SELECT COUNT(*) FILTER (status = 'open' AND sla_breach_prob > 0.85) AS critical_open,
  COUNT(DISTINCT customer_name) FILTER (risk_score > 80) AS high_risk_customers,
  COUNT(*) FILTER (processed_at IS NULL) AS pending_intake
FROM cases""")
def alert_conditions(spark, folder):
    wanted = ("status", "sla_breach_prob", "risk_score", "customer_name", "processed_at")
    return kpi.alert_conditions(cases(spark, folder, *wanted))


@query("d17_busiest_customer", over(CASES) + """
SELECT customer_name, COUNT(*) AS complaints FROM cases WHERE customer_name IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def busiest_customer(spark, folder):
    return history.busiest_customer(cases(spark, folder, "customer_name"))


@query("d18_customer_totals", over(CASES) + """
SELECT customer_name, COUNT(*) AS complaints, COUNT(DISTINCT category) AS categories FROM cases
WHERE customer_name IS NOT NULL GROUP BY 1""")
def customer_totals(spark, folder):
    return history.customer_totals(cases(spark, folder, "customer_name", "category"))


@query("b1_search", over(CASES) + """
SELECT id, date, customer_name, category, severity, channel FROM cases
WHERE category = 'UPI' AND severity = 'Critical' AND channel = 'twitter' ORDER BY date DESC, id DESC LIMIT 50""")
def search(spark, folder):
    wanted = ("id", "date", "customer_name", "category", "severity", "channel")
    return queue.search(cases(spark, folder, *wanted), category="UPI", severity="Critical", channel="twitter")


QUEUE_WHERE = """FROM cases WHERE severity IN ('Critical', 'High') AND category IN ('UPI', 'Card', 'Loan') AND channel <> 'branch'
  AND sla_breach_prob >= 0.5 ORDER BY priority_score DESC, id LIMIT 60"""


@query("b2_queue", over(CASES) + f"""
SELECT id, date, category, severity, channel, priority_score, sla_breach_prob {QUEUE_WHERE}""")
def queue_view(spark, folder):
    wanted = ("id", "date", "category", "severity", "channel", "priority_score", "sla_breach_prob")
    return queue.queue(cases(spark, folder, *wanted), ["Critical", "High"], ["UPI", "Card", "Loan"],
                       [c for c in views.CHANNELS if c != "branch"], high_risk_only=True)


@query("b5_queue_display", over(CASES) + f"""
SELECT id AS "Complaint ID", date AS "Date", customer_name AS "Customer", channel AS "Channel",
  CASE WHEN category IS NULL THEN '-' WHEN category_confidence = 'Needs Review' THEN category || ' (*)' ELSE category END AS "Category",
  severity AS "Severity", COALESCE(sentiment, '-') AS "Sentiment", priority_score AS "Priority",
  CASE WHEN amount_involved > 0 THEN 'Rs ' || format('{{:,}}', CAST(round_even(amount_involved, 0) AS BIGINT)) ELSE '-' END AS "Amount (INR)",
  sla_due_date AS "SLA Deadline",
  COALESCE(CAST(CAST(round_even(sla_breach_prob * 100, 0) AS BIGINT) AS VARCHAR) || '%', '-') AS "Breach probability",
  risk_score AS "Risk score", duplicate_of AS "Duplicate of"
{QUEUE_WHERE}""")
def queue_display(spark, folder):
    """B3, B4 and B5 on the queue of B2."""
    wanted = ("id", "date", "customer_name", "channel", "category", "severity", "sentiment", "priority_score",
              "amount_involved", "sla_due_date", "sla_breach_prob", "risk_score", "duplicate_of", "category_confidence")
    view = queue.queue(cases(spark, folder, *wanted), ["Critical", "High"], ["UPI", "Card", "Loan"],
                       [c for c in views.CHANNELS if c != "branch"], high_risk_only=True)
    return queue.display(view)


@query("b3_badges", over(CASES) + """
SELECT id, CASE WHEN category IS NULL THEN '-' WHEN category_confidence = 'Needs Review' THEN category || ' (*)' ELSE category END AS badge
FROM cases""")
def badges(spark, folder):
    rows = cases(spark, folder, "id", "category", "category_confidence")
    return rows.select("id", labels.badge(F.col("category"), F.col("category_confidence")).alias("badge"))


@query("b4_formatted_values", over(CASES) + """
SELECT id, CASE WHEN amount_involved > 0 THEN 'Rs ' || format('{:,}', CAST(round_even(amount_involved, 0) AS BIGINT)) ELSE '-' END AS amount_text,
  COALESCE(CAST(CAST(round_even(sla_breach_prob * 100, 0) AS BIGINT) AS VARCHAR) || '%', '-') AS breach_text FROM cases""")
def formatted_values(spark, folder):
    rows = cases(spark, folder, "id", "amount_involved", "sla_breach_prob")
    return rows.select("id", labels.rupees(F.col("amount_involved")).alias("amount_text"),
                       labels.percent(F.col("sla_breach_prob")).alias("breach_text"))


@query("b6_unprocessed", over(CASES) + """
SELECT id, date, channel FROM cases WHERE processed_at IS NULL ORDER BY date DESC, id DESC""")
def unprocessed(spark, folder):
    return queue.unprocessed(cases(spark, folder, "id", "date", "channel", "processed_at")).drop("processed_at")


REPLY_SQL = """CASE WHEN duplicate_of IS NULL THEN 'Dear ' || COALESCE(customer_name, 'Customer') ||
  E',\\n\\nThank you for contacting Union Bank of India regarding your ' || COALESCE(category, 'service') ||
  ' concern. We have registered your complaint under reference UBI/' || CAST(id AS VARCHAR) ||
  ' and our team will investigate and resolve it within ' || CAST(base_days AS VARCHAR) ||
  E' business days. For urgent assistance please call 1800-22-2244.\\n\\nRegards,\\nUnion Bank Customer Care\\n(standard template)' END"""
BASE_DAYS_SQL = """CASE category WHEN 'UPI' THEN 5 WHEN 'ATM' THEN 5 WHEN 'Card' THEN 7 WHEN 'NetBanking' THEN 7 ELSE 30 END AS base_days"""
DRAFTS = f"drafts AS (SELECT *, {REPLY_SQL} AS draft_response FROM (SELECT *, {BASE_DAYS_SQL} FROM cases))"


def drafted_cases(spark, folder):
    rows = cases(spark, folder, "id", "date", "customer_name", "category", "duplicate_of", "customer_email", "channel",
                 "account_no")
    days = views.sla.lookup(F.col("category"), views.sla.SLA_DAYS, views.sla.SLA_DAYS["General"])
    return store.with_drafts(rows, days)


@query("b7_drafted", over(CASES, DRAFTS) + """
SELECT id, date, draft_response FROM drafts WHERE draft_response IS NOT NULL ORDER BY date DESC, id DESC LIMIT 20""")
def drafted(spark, folder):
    return queue.drafted(drafted_cases(spark, folder)).select("id", "date", "draft_response")


@query("h29_standard_replies", over(CASES, DRAFTS) + "SELECT id, draft_response FROM drafts")
def standard_replies(spark, folder):
    return drafted_cases(spark, folder).select("id", "draft_response")


@query("a15_outbox", over(CASES, DRAFTS) + """
SELECT id, COALESCE(customer_email, CASE WHEN channel = 'bank_portal' THEN u.email END) AS to_email,
  'Update regarding your complaint ' || CAST(id AS VARCHAR) || ' - Union Bank of India' AS subject, draft_response AS body
FROM drafts LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS k, 'user' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email
  FROM customer WHERE c_custkey % 2 = 0) u ON account_no = k
WHERE draft_response IS NOT NULL AND COALESCE(customer_email, CASE WHEN channel = 'bank_portal' THEN u.email END) IS NOT NULL""")
def outbox(spark, folder):
    """Also C6: the account lookup of portal cases without an address of their own."""
    return store.outbox(drafted_cases(spark, folder), views.users(spark, folder), ["bank_portal"])


@query("b8_reviewable", over(CASES) + "SELECT id, date FROM cases WHERE category IS NOT NULL ORDER BY date DESC, id DESC")
def reviewable(spark, folder):
    return queue.reviewable(cases(spark, folder, "id", "date", "category"))


@query("b9_risk_tiers", over(CASES) + """
SELECT id, CASE WHEN risk_score IS NULL THEN 'Medium' WHEN risk_score >= 70 THEN 'Critical' WHEN risk_score >= 40 THEN 'High' ELSE 'Low' END AS tier
FROM (SELECT id, CASE WHEN id % 17 <> 0 THEN risk_score END AS risk_score FROM cases)""")
def risk_tiers(spark, folder):
    rows = cases(spark, folder, "id", "risk_score", "processed_at")
    score = F.when(F.col("processed_at").isNotNull(), F.col("risk_score"))
    return rows.select("id", risk.risk_tier(score).alias("tier"))


@query("b10_emotion_rank", over(CASES) + """
SELECT id, CASE sentiment WHEN 'Polite' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Frustrated' THEN 3 WHEN 'Angry' THEN 4 ELSE 0 END AS emotion
FROM cases""")
def emotion_ranks(spark, folder):
    return cases(spark, folder, "id", "sentiment").select("id", risk.emotion_rank(F.col("sentiment")).alias("emotion"))


@query("e1_latest_scored", over(CASES) + """
SELECT customer_name, id, date, risk_score,
  CASE WHEN risk_score >= 70 THEN 'Critical' WHEN risk_score >= 40 THEN 'High' ELSE 'Low' END AS tier
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_name ORDER BY date DESC, id DESC) AS rn FROM cases WHERE risk_score IS NOT NULL)
WHERE rn = 1""")
def latest_scored(spark, folder):
    return history.latest_scored(cases(spark, folder, "id", "customer_name", "date", "risk_score"))


@query("e2_emotion_timeline", over(CASES) + """
SELECT customer_name, date, id, category, severity, sentiment, amount_involved,
  CASE sentiment WHEN 'Polite' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Frustrated' THEN 3 WHEN 'Angry' THEN 4 ELSE 0 END AS emotion_level
FROM cases ORDER BY customer_name, date, id""")
def emotion_timeline(spark, folder):
    wanted = ("customer_name", "date", "id", "category", "severity", "sentiment", "amount_involved")
    return history.emotion_timeline(cases(spark, folder, *wanted))


@query("l4_customer_view", over(CASES) + """
SELECT t.customer_name, complaints, categories, latest_id, latest_risk,
  CASE WHEN latest_risk >= 70 THEN 'Critical' WHEN latest_risk >= 40 THEN 'High' ELSE 'Low' END AS tier
FROM (SELECT customer_name, COUNT(*) AS complaints, COUNT(DISTINCT category) AS categories FROM cases GROUP BY 1) t
JOIN (SELECT customer_name, id AS latest_id, risk_score AS latest_risk,
  ROW_NUMBER() OVER (PARTITION BY customer_name ORDER BY date DESC, id DESC) AS rn FROM cases) l
  ON t.customer_name = l.customer_name AND rn = 1""")
def customer_view(spark, folder):
    return history.customer_view(cases(spark, folder, "customer_name", "category", "id", "date", "risk_score"))


@query("f2_most_urgent", over(CASES) + """
SELECT id, sla_due_date, CAST(sla_due_date - DATE '2001-08-01' AS INTEGER) AS days_until_due, sla_breach_prob
FROM cases WHERE sla_due_date IS NOT NULL ORDER BY days_until_due, sla_breach_prob DESC NULLS LAST, id LIMIT 25""")
def most_urgent(spark, folder):
    rows = queue.most_urgent(cases(spark, folder, "id", "sla_due_date", "sla_breach_prob"), AS_OF)
    return rows.select("id", "sla_due_date", "days_until_due", "sla_breach_prob")


@query("g3_filter_values", over(CASES) + """
SELECT DISTINCT severity FROM cases WHERE severity IS NOT NULL ORDER BY 1""")
def filter_values(spark, folder):
    return store.distinct_values(cases(spark, folder, "severity"), "severity")


@query("h15_due_dates", over(CASES) + """
SELECT id, sla_days, sla_due_date, CAST(sla_due_date - DATE '2001-08-01' AS INTEGER) AS days_left FROM cases""")
def due_dates(spark, folder):
    """H15, H16 and C4."""
    rows = cases(spark, folder, "id", "category", "severity", "sla_due_date")
    return rows.select("id", sla.sla_days(F.col("category"), F.col("severity")).alias("sla_days"), "sla_due_date",
                       sla.days_until_due(F.col("sla_due_date"), AS_OF).alias("days_left"))


@query("a14_rule_join", over(CASES) + "SELECT id, sla_days AS days FROM cases")
def rule_join(spark, folder):
    """The rules as a dimension table: 24 rows fixed by the product, joined on (category, severity)."""
    rules = dims.sla_rules(spark)
    rows = cases(spark, folder, "id", "category", "severity").select(
        "id", F.coalesce("category", F.lit("General")).alias("category"), F.coalesce("severity", F.lit("Medium")).alias("severity")
    )
    joined = rows.join(F.broadcast(rules), ["category", "severity"], "left")
    days = F.greatest(F.lit(1), F.bround(F.col("base_days") * F.col("multiplier"), 0).cast("int"))
    return joined.select("id", days.alias("days"))


@query("h17_breach_rule", over(CASES) + """
SELECT id, round(GREATEST(0.02::DOUBLE, LEAST(0.92::DOUBLE, 0.18::DOUBLE
  + CASE severity WHEN 'Critical' THEN 0.35::DOUBLE WHEN 'High' THEN 0.20::DOUBLE WHEN 'Low' THEN -0.08::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN amount_involved >= 25000 THEN 0.10::DOUBLE ELSE 0::DOUBLE END)), 3) AS p FROM cases""")
def breach_rule(spark, folder):
    rows = cases(spark, folder, "id", "severity", "amount_involved")
    return rows.select("id", sla.breach_rule(F.col("severity"), F.col("amount_involved")).alias("p"))


@query("d19_run_summary", over(CASES, VECTORS, CLUSTERED) + """
SELECT COUNT(*) AS processed, 0::BIGINT AS errors, COUNT(duplicate_of) AS duplicates_found,
  (SELECT COUNT(*) FROM prof WHERE count >= 5 AND category_share >= 0.6) AS alerts_detected FROM cases WHERE processed_at IS NOT NULL""")
def run_summary(spark, folder):
    done = cases(spark, folder, "id", "duplicate_of", "processed_at").where(F.col("processed_at").isNotNull())
    return kpi.run_summary(done, rootcause.alerts(_labelled(spark, folder)))
