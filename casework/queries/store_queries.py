"""Table maintenance, history, feedback and metric queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework import schemas
from casework.functions import risk
from casework.operators import feedback, history, metrics, store, strikes
from casework.queries.base import CASES, REVIEWS, STRIKES, over, query
from casework.sources import views
from casework.sources.views import AS_OF, cases, table


@query("a2_scan", over(CASES) + """
SELECT id, date, channel, amount_involved FROM cases WHERE amount_involved >= 100000 ORDER BY date DESC, id DESC""")
def scan(spark, folder):
    """Also F1."""
    return store.scan(cases(spark, folder, "id", "date", "channel", "amount_involved"), F.col("amount_involved") >= 100000)


@query("a2_scan_limit", over(CASES) + "SELECT id, date, channel FROM cases ORDER BY date DESC, id DESC LIMIT 100")
def scan_limit(spark, folder):
    return store.scan(cases(spark, folder, "id", "date", "channel"), limit=100)


@query("a3_known_accounts", """
SELECT o_orderkey AS id, account_no, c_custkey IS NOT NULL AS known
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN -1 - o_custkey ELSE o_custkey END AS account_no FROM orders)
LEFT JOIN customer ON account_no = c_custkey""")
def known_accounts(spark, folder):
    """Every tenth request states an account that no customer has."""
    stated = F.when(F.col("o_orderkey") % 10 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))
    requests = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), stated.alias("account_no"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("account_no"))
    return store.known_keys(requests, customers, "account_no", "id")


INSERT_SQL = over(CASES) + """
SELECT id, date, channel, category FROM cases WHERE date < DATE '2001-07-01'
UNION ALL
SELECT id, date, 'portal', NULL FROM cases WHERE date >= DATE '2001-07-01'"""


@query("a5_insert_if_absent", INSERT_SQL)
def insert_if_absent(spark, folder):
    """Also C7 and G1: rows from July on are new, all rows arrive twice, stored rows keep their labels."""
    stored = cases(spark, folder, "id", "date", "channel", "category").where(F.col("date") < "2001-07-01")
    incoming = cases(spark, folder, "id", "date").withColumn("channel", F.lit("portal"))
    return store.insert_if_absent(stored, incoming.unionByName(incoming))


@query("a6_patch", over(CASES) + """
SELECT id, CASE WHEN severity = 'Critical' THEN 'escalated' ELSE status END AS status,
  CASE WHEN severity = 'Critical' THEN NULL ELSE resolved_at END AS resolved_at, channel FROM cases""")
def patch(spark, folder):
    base = cases(spark, folder, "id", "status", "resolved_at", "channel")
    critical = cases(spark, folder, "id", "severity").where(F.col("severity") == "Critical")
    patches = critical.select("id", F.lit("escalated").alias("status"), F.lit(None).cast("date").alias("resolved_at"))
    return store.patch(base, patches)


@query("a8_copy_table", over(CASES) + """
SELECT CAST(id AS VARCHAR) AS id, date, status, CAST(duplicate_of AS VARCHAR) AS duplicate_of, priority_score FROM cases""")
def copy_table(spark, folder):
    """Also A12: the source is conformed to the case schema; a third of the ids is already there."""
    source = cases(spark, folder, "id", "date", "status", "duplicate_of", "priority_score")
    target = source.where(F.col("id") % 3 == 0)
    copied = store.copy_table(source, target, schemas.CASE)
    return copied.select("id", "date", "status", "duplicate_of", "priority_score")


@query("a12_conform", over(CASES) + """
SELECT CAST(id AS VARCHAR) AS id, amount_involved, category, date, CAST(NULL AS VARCHAR) AS ml_category FROM cases""")
def conform(spark, folder):
    raw = cases(spark, folder, "id", "amount_involved", "category", "date").select(
        "id", F.col("amount_involved").cast("string").alias("amount_involved"), "category",
        F.concat(F.col("date").cast("string"), F.lit("T10:30:00.000Z")).alias("date"),
    )
    return schemas.conform(raw, schemas.CASE).select("id", "amount_involved", "category", "date", "ml_category")


@query("a16_allocate_ids", over(CASES) + """
SELECT id, date, 'UBI-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS new_id FROM (
  SELECT id, date, (SELECT 2 * MAX(c_custkey) FROM customer) + ROW_NUMBER() OVER (ORDER BY date, md5(CAST(id AS VARCHAR)), id) AS n FROM cases)""")
def allocate_ids(spark, folder):
    """Numbers follow the highest one allocated, which gaps have driven above the number of rows."""
    taken = table(spark, folder, "customer").select(F.concat(F.lit("UBI-"), (F.col("c_custkey") * 2).cast("string")).alias("id"))
    return store.allocate_ids(cases(spark, folder, "id", "date"), store.last_number(taken), "id", AS_OF)


@query("c9_dangling_references", over(CASES) + """
SELECT 'cases.duplicate_of' AS reference, CAST(duplicate_of AS VARCHAR) AS missing_key, COUNT(*) AS rows FROM cases
WHERE duplicate_of IS NOT NULL AND duplicate_of NOT IN (SELECT id FROM cases) GROUP BY 2
UNION ALL
SELECT 'orders.o_custkey', CAST(-1 - o_custkey AS VARCHAR), COUNT(*) FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 2""")
def dangling(spark, folder):
    rows = cases(spark, folder, "id", "duplicate_of")
    accounts = table(spark, folder, "customer")
    stated = F.when(F.col("o_orderkey") % 10 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))
    orders = table(spark, folder, "orders").select(stated.alias("o_custkey"))
    return store.dangling_references(rows, "duplicate_of", rows, "id", "cases.duplicate_of").unionByName(
        store.dangling_references(orders, "o_custkey", accounts, "c_custkey", "orders.o_custkey")
    )


@query("c10_originals", over(CASES) + """
SELECT d.id, d.duplicate_of, o.date AS original_date, o.status AS original_status
FROM cases d LEFT JOIN cases o ON d.duplicate_of = o.id WHERE d.duplicate_of IS NOT NULL""")
def originals(spark, folder):
    rows = cases(spark, folder, "id", "duplicate_of", "date", "status")
    return store.originals(rows, ["date", "status"]).select("id", "duplicate_of", "original_date", "original_status")


@query("g2_remaining_pool", over(CASES) + """
SELECT id FROM cases WHERE NOT (COALESCE(severity, '') = 'Low' AND COALESCE(sentiment, '') = 'Polite')""")
def remaining_pool(spark, folder):
    rows = cases(spark, folder, "id", "severity", "sentiment")
    picked = rows.where((F.col("severity") == "Low") & (F.col("sentiment") == "Polite"))
    return store.without(rows, picked).select("id")


@query("k22_audit_trail", over(CASES) + """
SELECT CAST(id AS VARCHAR) AS complaint_id, 'ops' AS actor, 'update' AS action,
  '{"status":"' || status || '"}' AS before_state, '{"status":"escalated"}' AS after_state
FROM cases WHERE severity = 'Critical' AND status <> 'escalated'""")
def audit_trail(spark, folder):
    before = cases(spark, folder, "id", "status", "severity")
    after = before.withColumn("status", F.when(F.col("severity") == "Critical", "escalated").otherwise(F.col("status")))
    trail = store.audit_trail(before, after, "id", ["status"], "ops")
    return trail.withColumn("complaint_id", F.col("complaint_id").cast("string"))


@query("c1_complaint_counts", over(CASES) + """
SELECT id, customer_name, COUNT(*) OVER (PARTITION BY customer_name) AS customer_complaint_count FROM cases""")
def complaint_counts(spark, folder):
    return history.complaint_counts(cases(spark, folder, "id", "customer_name"))


HISTORY = """hist AS (
  SELECT customer_name AS hist_name, COUNT(*) AS filed, COUNT(*) FILTER (sentiment IN ('Angry', 'Frustrated')) AS upset,
    COUNT(*) FILTER (COALESCE(status, 'open') = 'open') AS unresolved,
    COUNT(*) FILTER (channel IN ('twitter', 'whatsapp')) AS public, COUNT(DISTINCT category) AS categories
  FROM cases WHERE processed_at IS NOT NULL GROUP BY 1)"""


@query("c2_histories", over(CASES, HISTORY) + "SELECT hist_name AS customer_name, filed, upset, unresolved, public, categories FROM hist")
def histories(spark, folder):
    wanted = ("customer_name", "channel", "sentiment", "status", "category", "processed_at")
    return history.histories(cases(spark, folder, *wanted).where(F.col("processed_at").isNotNull()))


RISK_SQL = over(CASES, HISTORY) + """
SELECT id, CAST(GREATEST(0, LEAST(100, o)) AS INTEGER) AS risk_ombudsman, CAST(GREATEST(0, LEAST(100, c)) AS INTEGER) AS risk_churn,
  CAST(GREATEST(0, LEAST(100, s)) AS INTEGER) AS risk_social,
  GREATEST(0, LEAST(100, CAST(round_even(0.45::DOUBLE * o + 0.30::DOUBLE * c + 0.25::DOUBLE * s, 0) AS INTEGER))) AS risk_score
FROM (SELECT id,
  CAST(round_even(COALESCE(sla_breach_prob, 0) * 40::DOUBLE, 0) AS INTEGER)
    + CASE severity WHEN 'Critical' THEN 30 WHEN 'High' THEN 20 WHEN 'Low' THEN 3 ELSE 10 END + LEAST(filed * 3, 15)
    + CASE WHEN amount_involved >= 100000 THEN 12 WHEN amount_involved >= 25000 THEN 6 ELSE 0 END + LEAST(upset * 2, 8) AS o,
  LEAST(filed * 6, 30) + LEAST(unresolved * 5, 25) + LEAST(categories * 6, 20)
    + CASE WHEN sentiment IN ('Angry', 'Frustrated') THEN 12 ELSE 0 END
    + CASE WHEN severity IN ('Critical', 'High') THEN 8 ELSE 0 END AS c,
  LEAST(public * 12, 45) + CASE WHEN channel IN ('twitter', 'whatsapp') THEN 18 ELSE 0 END
    + CASE sentiment WHEN 'Angry' THEN 22 WHEN 'Frustrated' THEN 10 ELSE 0 END
    + CASE WHEN severity = 'Critical' THEN 8 ELSE 0 END AS s
  FROM cases JOIN hist ON customer_name = hist_name WHERE processed_at IS NOT NULL)"""


@query("k19_recompute_risk", RISK_SQL)
def recompute_risk(spark, folder):
    """H21-H24 on the processed history of every customer."""
    wanted = ("id", "customer_name", "channel", "sentiment", "status", "category", "severity", "amount_involved",
              "sla_breach_prob", "processed_at")
    scored = history.recompute_risk(cases(spark, folder, *wanted))
    return scored.select("id", "risk_score", "risk_ombudsman", "risk_churn", "risk_social")


PRIORITY_SQL = over(CASES) + """
SELECT id, round(GREATEST(0::DOUBLE, LEAST(100::DOUBLE, sev * 12 + sent * 7
  + LEAST(COALESCE(amount_involved, 0) / 5000::DOUBLE, 20::DOUBLE) + LEAST(n * 3, 12)
  + LEAST(GREATEST(age, 0) * 0.4::DOUBLE, 10::DOUBLE) + p * 18::DOUBLE - dup * 8)), 7) AS priority
FROM (SELECT id, amount_involved, COUNT(*) OVER (PARTITION BY customer_name) AS n,
  CASE severity WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Low' THEN 0 ELSE 1 END AS sev,
  CASE sentiment WHEN 'Angry' THEN 3 WHEN 'Frustrated' THEN 2 WHEN 'Polite' THEN 0 ELSE 1 END AS sent,
  DATE '2001-08-01' - date AS age, COALESCE(sla_breach_prob, 0.3::DOUBLE) AS p,
  CASE WHEN duplicate_of IS NULL THEN 0 ELSE 1 END AS dup FROM cases)"""


@query("h25_priority", PRIORITY_SQL)
def priority(spark, folder):
    wanted = ("id", "customer_name", "severity", "sentiment", "amount_involved", "date", "sla_breach_prob", "duplicate_of")
    rows = history.complaint_counts(cases(spark, folder, *wanted))
    c = F.col
    score = risk.priority_composite(
        c("severity"), c("sentiment"), c("amount_involved"), c("customer_complaint_count"),
        F.date_diff(F.lit(AS_OF).cast("date"), c("date")), c("duplicate_of").isNotNull().cast("int"), c("sla_breach_prob"),
    )
    return rows.select("id", F.round(score, 7).alias("priority"))


LATEST_CORRECTIONS = """latest AS (
  SELECT complaint_id, field, corrected_value FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY complaint_id, field ORDER BY created_at DESC, id DESC) AS rn
    FROM reviews WHERE NOT is_correct AND corrected_value IS NOT NULL) WHERE rn = 1)"""


@query("e6_latest_corrections", over(REVIEWS, LATEST_CORRECTIONS) + "SELECT * FROM latest")
def latest_corrections(spark, folder):
    return feedback.latest_corrections(views.reviews(spark, folder))


@query("c8_apply_corrections", over(CASES, REVIEWS, LATEST_CORRECTIONS) + """
SELECT c.id, COALESCE(k.corrected_value, c.category) AS category, COALESCE(s.corrected_value, c.severity) AS severity
FROM cases c LEFT JOIN latest k ON k.complaint_id = c.id AND k.field = 'category'
LEFT JOIN latest s ON s.complaint_id = c.id AND s.field = 'severity'""")
def apply_corrections(spark, folder):
    """Also A10."""
    base = cases(spark, folder, "id", "category", "severity")
    return feedback.apply_corrections(base, views.reviews(spark, folder), ("category", "severity"))


@query("e7_feedback_listing", over(REVIEWS) + """
SELECT id, complaint_id, field, corrected_value, created_at FROM reviews ORDER BY created_at DESC, id DESC""")
def feedback_listing(spark, folder):
    """Newest first."""
    return feedback.listing(views.reviews(spark, folder)).select("id", "complaint_id", "field", "corrected_value", "created_at")


@query("d14_feedback_stats", over(REVIEWS) + """
SELECT COUNT(*) AS total, COUNT(*) FILTER (is_correct) AS correct, COUNT(*) FILTER (NOT is_correct) AS corrections,
  CAST(COUNT(*) FILTER (is_correct) AS DOUBLE) / COUNT(*) AS accuracy_rate FROM reviews""")
def feedback_stats(spark, folder):
    return feedback.stats(views.reviews(spark, folder))


@query("d14_corrections_by_field", over(REVIEWS) + """
SELECT field, COUNT(*) AS corrections FROM reviews WHERE NOT is_correct GROUP BY 1""")
def corrections_by_field(spark, folder):
    return feedback.corrections_by_field(views.reviews(spark, folder))


@query("d15_agreement", over(CASES) + """
SELECT 'category' AS family, COUNT(*) FILTER (category_confidence = 'High Confidence') AS agreed, COUNT(category_confidence) AS compared,
  round(COUNT(*) FILTER (category_confidence = 'High Confidence') * 100::DOUBLE / COUNT(category_confidence), 1) AS percent FROM cases""")
def agreement(spark, folder):
    return feedback.agreement(cases(spark, folder, "category_confidence"), {"category": "category_confidence"})


@query("d22_class_report", """
SELECT class, round(COALESCE(CAST(hits AS DOUBLE) / NULLIF(pred, 0), 0), 4) AS precision,
  round(COALESCE(CAST(hits AS DOUBLE) / NULLIF(support, 0), 0), 4) AS recall,
  round(COALESCE(hits * 2.0::DOUBLE / NULLIF(pred + support, 0), 0), 4) AS f1, support
FROM (SELECT class, COUNT(*) FILTER (quality = class AND toxic = class) AS hits, COUNT(*) FILTER (toxic = class) AS pred,
  COUNT(*) FILTER (quality = class) AS support FROM labels, (VALUES (0), (1)) c(class) GROUP BY 1)""")
def class_report(spark, folder):
    return metrics.class_report(table(spark, folder, "labels"), "quality", "toxic", [0, 1])


@query("d22_confusion", "SELECT quality AS actual, toxic AS predicted, COUNT(*) AS rows FROM labels GROUP BY 1, 2")
def confusion(spark, folder):
    return metrics.confusion(table(spark, folder, "labels"), "quality", "toxic")


@query("d22_accuracy", """
SELECT COUNT(*) AS rows, round(COUNT(*) FILTER (quality = toxic) / CAST(COUNT(*) AS DOUBLE), 4) AS accuracy FROM labels""")
def accuracy(spark, folder):
    return metrics.accuracy(table(spark, folder, "labels"), "quality", "toxic")


@query("d23_class_distribution", over(CASES) + """
SELECT category AS class, COUNT(*) AS rows FROM cases WHERE category IS NOT NULL GROUP BY 1""")
def class_distribution(spark, folder):
    return metrics.class_distribution(cases(spark, folder, "category"), "category")


@query("d24_regression", over(CASES) + """
SELECT round(AVG(ABS(a - p)), 3) AS mae, round(1 - AVG((a - p) * (a - p)) / VAR_POP(a), 4) AS r2
FROM (SELECT CAST(priority_score AS DOUBLE) AS a, CAST(risk_score AS DOUBLE) AS p FROM cases)""")
def regression(spark, folder):
    rows = cases(spark, folder, "priority_score", "risk_score")
    return metrics.regression(
        rows.select(*[F.col(c).cast("double").alias(c) for c in rows.columns]), "priority_score", "risk_score"
    )


@query("k21_drift", over(CASES) + """,
long AS (SELECT 'category' AS col, COALESCE(category, '(null)') AS bucket, date FROM cases
  UNION ALL SELECT 'severity', COALESCE(severity, '(null)'), date FROM cases
  UNION ALL SELECT 'amount_involved', CASE WHEN amount_involved IS NULL THEN '(null)' ELSE CAST(LEAST(CAST(FLOOR(amount_involved / 25000) AS BIGINT), 4) AS VARCHAR) END, date FROM cases),
share AS (SELECT col, bucket,
  GREATEST(SUM(CASE WHEN date < DATE '2001-07-02' THEN 1 ELSE 0 END) / SUM(SUM(CASE WHEN date < DATE '2001-07-02' THEN 1 ELSE 0 END)) OVER (PARTITION BY col), 0.0001::DOUBLE) AS r,
  GREATEST(SUM(CASE WHEN date >= DATE '2001-07-02' THEN 1 ELSE 0 END) / SUM(SUM(CASE WHEN date >= DATE '2001-07-02' THEN 1 ELSE 0 END)) OVER (PARTITION BY col), 0.0001::DOUBLE) AS c
  FROM long GROUP BY 1, 2)
SELECT col AS "column", round(SUM((c - r) * ln(c / r)), 4) AS psi, round(SUM((c - r) * ln(c / r)), 4) > 0.2 AS drifted,
  (SELECT COUNT(*) FROM cases WHERE date >= DATE '2001-07-02') < 30 AS too_small FROM share GROUP BY 1""")
def drift(spark, folder):
    """Cases of the last 30 days against the cases before."""
    rows = cases(spark, folder, "category", "severity", "amount_involved", "date")
    recent = F.col("date") >= F.date_sub(F.lit(AS_OF).cast("date"), 30)
    bucket = F.least(F.floor(F.col("amount_involved") / 25000), F.lit(4))
    groups = {
        "category": F.col("category"),
        "severity": F.col("severity"),
        "amount_involved": F.when(F.col("amount_involved").isNotNull(), bucket),
    }
    return metrics.drift(rows.where(~recent), rows.where(recent), groups)


@query("k21_numeric_drift", over(CASES) + """,
old AS (SELECT amount_involved AS x FROM cases WHERE date < DATE '2001-07-02' AND amount_involved IS NOT NULL),
edges AS (SELECT DISTINCT unnest(quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM old),
sides AS (SELECT date < DATE '2001-07-02' AS before, amount_involved AS x FROM cases),
ranks AS (SELECT e, avg(CASE WHEN x <= e THEN 1.0 ELSE 0 END) FILTER (WHERE before) AS b, avg(CASE WHEN x <= e THEN 1.0 ELSE 0 END) FILTER (WHERE NOT before) AS a
  FROM sides, edges WHERE x IS NOT NULL GROUP BY e)
SELECT 'amount_involved' AS "column", max(abs(a - b)) > 0.1 AS moved, false AS edge_off FROM ranks""")
def numeric_drift(spark, folder):
    """Deciles of a quantile sketch: whether the amounts of the last 30 days moved, and whether any edge misses its share of the earlier rows by over 1 % beyond its ties."""
    rows = cases(spark, folder, "amount_involved", "date")
    recent = F.col("date") >= F.date_sub(F.lit(AS_OF).cast("date"), 30)
    before, now = rows.where(~recent), rows.where(recent)
    found = metrics.numeric_drift(before, now, ["amount_involved"])
    edges = metrics.quantile_edges(metrics.quantile_sketches(before, ["amount_involved"]), ["amount_involved"], 10)["amount_involved"]
    x = F.col("amount_involved")
    shares = [(F.avg((x < e).cast("int")), F.avg((x <= e).cast("int"))) for e in edges]
    tenths = [F.lit(i / 10) for i in range(1, 10)]
    off = [~reduce(Column.__or__, [(low - 0.01 <= t) & (high + 0.01 >= t) for low, high in shares]) for t in tenths]
    misses = before.where(x.isNotNull()).agg(reduce(Column.__or__, off).alias("edge_off"))
    return found.select("column", (F.col("distance") > 0.1).alias("moved")).join(misses.withColumn("column", F.lit("amount_involved")), "column")



@query("d20_strikes_per_day", over(STRIKES) + """
SELECT account_number, CAST(created_at AS DATE) AS day, COUNT(*) AS strikes FROM strikes GROUP BY 1, 2""")
def strikes_per_day(spark, folder):
    return strikes.per_day(views.strikes(spark, folder))


@query("e5_recent_strikes", over(STRIKES) + """
SELECT account_number, id, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY account_number ORDER BY created_at DESC, id DESC) AS rn FROM strikes) WHERE rn <= 20""")
def recent_strikes(spark, folder):
    return strikes.recent(views.strikes(spark, folder)).select("account_number", "id", "rank")


@query("i3_blocked_accounts", over(STRIKES) + """
SELECT account_number, MAX(n) AS strikes_on_worst_day FROM (
  SELECT account_number, CAST(created_at AS DATE) AS day, COUNT(*) AS n FROM strikes
  WHERE floor(date_diff('second', created_at, TIMESTAMP '2024-01-30 23:59:59') / 86400.0) <= 2 GROUP BY 1, 2)
WHERE n >= 2 GROUP BY 1""")
def blocked_accounts(spark, folder):
    """The busiest account-day of the test table has few strikes, so the threshold is lowered to two."""
    return strikes.blocked_accounts(views.strikes(spark, folder), "2024-01-30 23:59:59", threshold=2)
