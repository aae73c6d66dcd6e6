"""Duplicate, root-cause and whole-enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.functions import vectors as vec
from casework.models.category import sentiment_scorer_by_rule
from casework.operators import duplicates, kpi, rootcause
from casework.plans import enrich as plan
from casework.queries.base import CASES, VECTORS, over, query
from casework.queries.text_queries import KEYWORD_SQL
from casework.sources import views

# The driver vectors are near random: no pair of one label reaches 0.78, so the queries use a lower threshold.
THRESHOLD = 0.30

SIM_SQL = "list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding)))"


def _ranked_sql(condition: str) -> str:
    return f"""
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY copy DESC, similarity DESC, neighbour) AS rank FROM (
    SELECT a.id, b.id AS neighbour, a.embedding = b.embedding AS copy,
      CASE WHEN a.embedding = b.embedding THEN 1.0::DOUBLE ELSE round({SIM_SQL}, 9) END AS similarity
    FROM vectors a JOIN vectors b ON a.customer_name = b.customer_name AND {condition}))"""


@query("e3_neighbours", over(VECTORS, _ranked_sql("a.id <> b.id")) + """
SELECT id, neighbour, similarity, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5""")
def neighbours(spark, folder):
    """The five nearest vectors of the same customer."""
    return duplicates.neighbours(views.vectors(spark, folder).select("id", "customer_name", "embedding"))


@query("j2_duplicates", over(VECTORS, _ranked_sql("a.id <> b.id")) + """
SELECT v.id, CASE WHEN similarity >= 0.30 THEN neighbour END AS duplicate_of, round(COALESCE(similarity, 0), 4) AS similarity
FROM vectors v LEFT JOIN ranked r ON v.id = r.id AND rank = 1 AND similarity > 0""")
def detect(spark, folder):
    return duplicates.detect(views.vectors(spark, folder).select("id", "customer_name", "embedding"), THRESHOLD)


@query("j3_duplicates_of_earlier", over(VECTORS, _ranked_sql("b.id < a.id")) + """
SELECT v.id, CASE WHEN similarity >= 0.30 THEN neighbour END AS duplicate_of, round(COALESCE(similarity, 0), 4) AS similarity
FROM vectors v LEFT JOIN ranked r ON v.id = r.id AND rank = 1 AND similarity > 0""")
def detect_earlier(spark, folder):
    rows = views.vectors(spark, folder).select("id", "customer_name", "embedding")
    return duplicates.detect(rows, THRESHOLD, mode="earlier")


@query("h36_vector_text", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last FROM embeddings""")
def vector_text(spark, folder):
    rows = views.table(spark, folder, "embeddings").select(
        "vec_id", F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ", "), F.lit("]")).alias("t")
    )
    parsed = rows.select("vec_id", vec.parse_vector(F.col("t")).alias("v"))
    ends = {"first": F.element_at("v", 1), "last": F.element_at("v", -1)}
    return parsed.select("vec_id", F.size("v").alias("dims"), *[v.cast("double").alias(n) for n, v in ends.items()])


def _two_customers(spark, folder):
    """Two customers own all vectors, so that each is cut into blocks."""
    return views.vectors(spark, folder).withColumn("customer_name", F.concat(F.lit("half"), (F.col("id") % 2).cast("string")))


BLOCK = 16


@query("c3_block_sizes", f"""
SELECT 'half' || CAST(vec_id % 2 AS VARCHAR) AS customer_name, COUNT(*) AS vectors,
  CAST(ceil(COUNT(*) / {BLOCK}.0) * (ceil(COUNT(*) / {BLOCK}.0) + 1) / 2 AS BIGINT) AS cells FROM embeddings GROUP BY 1""")
def block_sizes(spark, folder):
    return duplicates.block_sizes(_two_customers(spark, folder), BLOCK)


@query("c3_blocked_neighbours", over(VECTORS.replace("vectors AS", "all_vectors AS", 1),
    "vectors AS (SELECT * REPLACE ('half' || CAST(id % 2 AS VARCHAR) AS customer_name) FROM all_vectors)", _ranked_sql("a.id <> b.id")) + """
SELECT id, neighbour, similarity, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5""")
def blocked_neighbours(spark, folder):
    """The five nearest vectors of customers that are cut into many cells."""
    return duplicates.neighbours(_two_customers(spark, folder).select("id", "customer_name", "embedding"), block_rows=BLOCK)


CLUSTERED = """
labelled AS (SELECT id % 8 AS cluster_id, CASE WHEN id % 8 = 7 THEN CASE id % 3 WHEN 0 THEN 'UPI' WHEN 1 THEN 'Card' ELSE 'Loan' END
    WHEN id % 5 < 4 THEN CASE id % 8 WHEN 0 THEN 'UPI' WHEN 1 THEN 'ATM' WHEN 2 THEN 'Card'
    WHEN 3 THEN 'Loan' WHEN 4 THEN 'NetBanking' ELSE 'General' END ELSE category END AS category,
  CASE WHEN id % 8 = 3 THEN 'Pune' WHEN id % 8 = 5 THEN NULL ELSE location END AS location FROM vectors),
cats AS (SELECT cluster_id, COALESCE(category, 'Unknown') AS v, COUNT(*) AS n FROM labelled GROUP BY 1, 2),
locs AS (SELECT cluster_id, COALESCE(location, 'Unknown') AS v, COUNT(*) AS n FROM labelled GROUP BY 1, 2),
prof AS (SELECT c.cluster_id, total AS count, c.v AS category, CAST(c.n AS DOUBLE) / total AS category_share, l.v AS top_city,
    CAST(l.n AS DOUBLE) / total AS city_share, city_count, named, phrase FROM
  (SELECT *, SUM(n) OVER (PARTITION BY cluster_id)::BIGINT AS total, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY n DESC, v) AS rn FROM cats) c
  JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY n DESC, v) AS rn, COUNT(*) OVER (PARTITION BY cluster_id) AS city_count FROM locs) l
    ON c.cluster_id = l.cluster_id AND c.rn = 1 AND l.rn = 1
  LEFT JOIN (SELECT cluster_id, SUM(n)::BIGINT AS named, string_agg(v || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY n DESC, v) AS phrase
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY n DESC, v) AS rn FROM locs) WHERE rn <= 3 AND v <> 'Unknown' GROUP BY 1) t
    ON c.cluster_id = t.cluster_id)"""


def _labelled(spark, folder):
    """Given clusters: KMeans labels differ between engines, the counting after them does not. Cluster 7 has no dominant
    category and raises no alert."""
    key = F.col("id") % 8
    rows = views.vectors(spark, folder)
    names = F.when(key == 0, "UPI").when(key == 1, "ATM").when(key == 2, "Card").when(key == 3, "Loan").when(
        key == 4, "NetBanking").otherwise("General")
    return rows.select(
        key.alias("cluster_id"),
        F.when(key == 7, F.when(F.col("id") % 3 == 0, "UPI").when(F.col("id") % 3 == 1, "Card").otherwise("Loan"))
        .when(F.col("id") % 5 < 4, names).otherwise(F.col("category")).alias("category"),
        F.when(key == 3, "Pune").when(key != 5, F.col("location")).alias("location"),
    )


@query("d21_cluster_profiles", over(VECTORS, CLUSTERED) + """
SELECT cluster_id, count, category, round(category_share, 4) AS category_share, top_city, round(city_share, 4) AS city_share, city_count,
  COALESCE(phrase, '') AS top_cities FROM prof""")
def cluster_profiles(spark, folder):
    """D21 and E4."""
    found = rootcause.profiles(_labelled(spark, folder))
    phrase = F.array_join(F.transform(
        "top_cities", lambda c: F.concat(c["city"], F.lit(" ("), c["n"].cast("string"), F.lit(")"))), ", ")
    return found.withColumns({"top_cities": phrase, "category_share": F.round("category_share", 4),
                              "city_share": F.round("city_share", 4)})


@query("j5_root_cause_alerts", over(VECTORS, CLUSTERED) + """
SELECT cluster_id, category, CASE WHEN city_share >= 0.4 THEN top_city END AS location, count, round(category_share, 2) AS category_share,
  round(city_share, 2) AS location_share,
  CASE WHEN city_share >= 0.4 THEN CAST(count AS VARCHAR) || ' ' || category || ' complaints concentrated in ' || top_city || ' ('
      || CAST(CAST(round_even(city_share * 100, 0) AS BIGINT) AS VARCHAR) || '% of cluster) -- possible local ' || category || ' service issue.'
    WHEN phrase IS NOT NULL THEN CAST(count AS VARCHAR) || ' ' || category || ' complaints across ' || CAST(city_count AS VARCHAR)
      || ' cities. Top hotspots: ' || phrase || CASE WHEN count > named THEN ' + ' || CAST(count - named AS VARCHAR) || ' elsewhere' ELSE '' END
      || '. Possible systemic ' || category || ' issue.'
    ELSE CAST(count AS VARCHAR) || ' ' || category || ' complaints, location unknown -- possible systemic ' || category || ' issue.' END AS summary
FROM prof WHERE count >= 5 AND category_share >= 0.6 ORDER BY count DESC, category_share DESC, cluster_id""")
def root_cause_alerts(spark, folder):
    """J5, H33 and F3."""
    return rootcause.alerts(_labelled(spark, folder))


@query("d16_systemic_banner", over(VECTORS, CLUSTERED) + """
, big AS (SELECT *, ROW_NUMBER() OVER (ORDER BY count DESC, cluster_id) AS rk FROM prof WHERE count >= 20 AND category_share >= 0.6)
SELECT COUNT(*) AS clusters, COALESCE(SUM(count), 0)::BIGINT AS cases, string_agg(CASE WHEN rk <= 3 THEN CAST(count AS VARCHAR) || ' ' || category
  || CASE WHEN city_share >= 0.4 THEN ' (' || top_city || ')' ELSE '' END END, '; ' ORDER BY rk) AS preview FROM big""")
def systemic_banner(spark, folder):
    from casework.operators.kpi import systemic_banner as banner

    return banner(rootcause.alerts(_labelled(spark, folder)))


@query("j4_clusters", "SELECT COUNT(*) AS vectors, 12 AS clusters, 1 AS within FROM embeddings")
def clusters(spark, folder):
    """KMeans over all vectors, the best of ten restarts: every vector in one of twelve clusters."""
    sizes = rootcause.assign_clusters(views.vectors(spark, folder)).groupBy("cluster_id").agg(F.count("*").alias("n"))
    inside = F.min(F.col("cluster_id").between(0, 11).cast("int"))
    return sizes.agg(F.sum("n").alias("vectors"), F.count("*").cast("int").alias("clusters"), inside.alias("within"))


@query("j6_detected_alerts", "SELECT 1 AS sized, 1 AS dominated, 1 AS ordered, 1 AS placed")
def detected_alerts(spark, folder):
    """J4 to J6 end to end on fitted clusters of the vectors: every alert keeps the rules."""
    found = rootcause.numbered(rootcause.detect(views.vectors(spark, folder)), "2001-08-01 00:00:00")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("id", "count"))), lambda x: x["count"])
    every = lambda c: F.coalesce(F.min(c.cast("int")), F.lit(1))
    sums = found.agg(
        every(F.col("count") >= rootcause.MIN_CLUSTER).alias("sized"), every(F.contains("summary", F.col("category"))).alias("dominated"),
        listed.alias("listed"), every(F.col("cluster_id").between(0, 11)).alias("placed"),
    )
    return sums.select("sized", "dominated", (F.col("listed") == F.reverse(F.array_sort("listed"))).cast("int").alias("ordered"), "placed")


@query("j6_planted_alerts", over(VECTORS) + """
SELECT max(v.category) AS category, COUNT(*) AS count, round(COUNT(v.category) / COUNT(*), 2) AS category_share
FROM vectors v JOIN embeddings e ON v.id = e.vec_id GROUP BY e.label % 6, e.vec_id % 2 HAVING COUNT(*) >= 5 AND COUNT(v.category) >= 0.6 * COUNT(*)""")
def planted_alerts(spark, folder):
    """J4 to J6 where alerts are certain: two far corners for every category, so twelve clusters that one category owns."""
    rows = views.vectors(spark, folder).join(views.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    corner = F.col("label") % 6 * 2 + F.col("id") % 2
    far = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i == corner, 50.0).otherwise(0.0).cast("float"))
    found = rootcause.detect(rows.withColumn("embedding", F.concat("embedding", far)).drop("label"))
    return found.select("category", "count", "category_share")


SEVERITY_SQL = r"""CASE WHEN amount_involved >= 50000 THEN 'Critical'
  WHEN regexp_matches(text, '(?i)unauthor|fraud|stuck|debit.{0,15}fail|debited') THEN 'High'
  WHEN amount_involved > 0 THEN 'Medium' ELSE 'Low' END"""
SENTIMENT_SQL = r"""CASE WHEN regexp_matches(text, '(?i)unacceptable|disgust|outrage|terrible|worst|!!') THEN 'Angry'
  WHEN regexp_matches(text, '(?i)kindly|please|would you|appreciate|sir/madam|कृपया') THEN 'Polite'
  WHEN contains(text, '!') OR contains(text, '?') THEN 'Frustrated' ELSE 'Neutral' END"""

ENRICH = f"""
base AS (SELECT id, customer_name, channel, date, amount_involved, COALESCE(text, '') AS text, CAST(embedding AS DOUBLE[]) AS embedding
  FROM cases LEFT JOIN documents ON doc_id = id LEFT JOIN embeddings ON vec_id = id),
labelled AS (SELECT *, {KEYWORD_SQL} AS cat, {SEVERITY_SQL} AS sev, {SENTIMENT_SQL} AS sent FROM base),
dups AS (SELECT id, neighbour, similarity FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY similarity DESC, odate, neighbour) AS rn FROM (
    SELECT a.id, b.id AS neighbour, b.date AS odate,
      round({SIM_SQL}, 9) AS similarity
    FROM base a JOIN base b ON a.customer_name = b.customer_name AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL
      AND (b.date, b.id) < (a.date, a.id))) WHERE rn = 1 AND similarity > 0),
decided AS (SELECT l.*, CASE WHEN similarity >= 0.30 THEN neighbour END AS duplicate_of, round(COALESCE(similarity, 0), 4) AS sim,
    GREATEST(1, CAST(round_even(CAST(CASE cat WHEN 'UPI' THEN 5 WHEN 'ATM' THEN 5 WHEN 'Card' THEN 7 WHEN 'NetBanking' THEN 7 ELSE 30 END AS DOUBLE)
      * CAST(CASE sev WHEN 'Critical' THEN 0.5 WHEN 'High' THEN 0.7 WHEN 'Low' THEN 1.2 ELSE 1.0 END AS DOUBLE), 0) AS INTEGER)) AS days,
    round(GREATEST(0.02::DOUBLE, LEAST(0.92::DOUBLE, 0.18::DOUBLE
      + CASE sev WHEN 'Critical' THEN 0.35::DOUBLE WHEN 'High' THEN 0.20::DOUBLE WHEN 'Low' THEN -0.08::DOUBLE ELSE 0::DOUBLE END
      + CASE WHEN amount_involved >= 25000 THEN 0.10::DOUBLE ELSE 0::DOUBLE END)), 3) AS p
  FROM labelled l LEFT JOIN dups d ON l.id = d.id),
final AS (SELECT *, CASE WHEN duplicate_of IS NOT NULL THEN 'auto_resolved_dup' WHEN sev IN ('Low', 'Medium') AND sent = 'Polite'
    THEN 'auto_resolved_std' ELSE 'open' END AS status FROM decided),
h AS (SELECT customer_name AS hn, COUNT(*) AS filed, COUNT(*) FILTER (sent IN ('Angry', 'Frustrated')) AS upset,
    COUNT(*) FILTER (status = 'open') AS unresolved, COUNT(*) FILTER (channel IN ('twitter', 'whatsapp')) AS public,
    COUNT(DISTINCT cat) AS categories FROM final GROUP BY 1),
scores AS (SELECT final.*, filed,
    CAST(round_even(p * 40::DOUBLE, 0) AS INTEGER) + CASE sev WHEN 'Critical' THEN 30 WHEN 'High' THEN 20 WHEN 'Low' THEN 3 ELSE 10 END
      + LEAST(filed * 3, 15) + CASE WHEN amount_involved >= 100000 THEN 12 WHEN amount_involved >= 25000 THEN 6 ELSE 0 END + LEAST(upset * 2, 8) AS o,
    LEAST(filed * 6, 30) + LEAST(unresolved * 5, 25) + LEAST(categories * 6, 20) + CASE WHEN sent IN ('Angry', 'Frustrated') THEN 12 ELSE 0 END
      + CASE WHEN sev IN ('Critical', 'High') THEN 8 ELSE 0 END AS c,
    LEAST(public * 12, 45) + CASE WHEN channel IN ('twitter', 'whatsapp') THEN 18 ELSE 0 END
      + CASE sent WHEN 'Angry' THEN 22 WHEN 'Frustrated' THEN 10 ELSE 0 END + CASE WHEN sev = 'Critical' THEN 8 ELSE 0 END AS s
  FROM final JOIN h ON customer_name = hn)"""

ENRICH_SELECT = """
SELECT id, cat AS category, sev AS severity, sent AS sentiment, duplicate_of, sim AS similarity, date + days AS sla_due_date, p AS sla_breach_prob, status,
  CAST(LEAST(100, o) AS INTEGER) AS risk_ombudsman, CAST(LEAST(100, c) AS INTEGER) AS risk_churn, CAST(LEAST(100, s) AS INTEGER) AS risk_social,
  LEAST(100, CAST(round_even(0.45::DOUBLE * o + 0.30::DOUBLE * c + 0.25::DOUBLE * s, 0) AS INTEGER)) AS risk_score,
  CAST(round_even(GREATEST(0::DOUBLE, LEAST(100::DOUBLE, CASE sev WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Low' THEN 0 ELSE 1 END * 12
    + CASE sent WHEN 'Angry' THEN 3 WHEN 'Frustrated' THEN 2 WHEN 'Polite' THEN 0 ELSE 1 END * 7
    + LEAST(COALESCE(amount_involved, 0) / 5000::DOUBLE, 20::DOUBLE) + LEAST(filed * 3, 12)
    + LEAST((DATE '2001-08-01' - date) * 0.4::DOUBLE, 10::DOUBLE) + p * 18::DOUBLE
    - CASE WHEN duplicate_of IS NULL THEN 0 ELSE 8 END)), 0) AS INTEGER) AS priority_score,
  CASE WHEN duplicate_of IS NULL THEN 1 ELSE 0 END AS drafted, CAST(NULL AS VARCHAR) AS ml_category, 'Unknown' AS category_confidence,
  CASE sent WHEN 'Polite' THEN 'positive' WHEN 'Neutral' THEN 'neutral' ELSE 'negative' END AS ml_sentiment, 'High Confidence' AS sentiment_confidence
FROM scores"""


@query("l1_enrichment", over(CASES, ENRICH) + ENRICH_SELECT)
def enrichment(spark, folder):
    """All nine stages over every case, its document and its vector; the rule scorer gives the second opinion on sentiment."""
    done = plan.enrich(views.filed_texts(spark, folder), views.AS_OF, THRESHOLD, sentiment=sentiment_scorer_by_rule)
    return done.select(
        "id", "category", "severity", "sentiment", "duplicate_of", "similarity", "sla_due_date", "sla_breach_prob", "status",
        "risk_ombudsman", "risk_churn", "risk_social", "risk_score", "priority_score",
        F.col("draft_response").isNotNull().cast("int").alias("drafted"),
        "ml_category", "category_confidence", "ml_sentiment", "sentiment_confidence",
    )


@query("l2_pending_run", over(CASES) + """
SELECT COUNT(*) AS processed, COUNT(*) FILTER (id % 5 = 0) AS errors, 1 AS alerts_listed FROM cases WHERE processed_at IS NULL""")
def pending_run(spark, folder):
    """B6 then L1 on the queue, the clusters of all vectors, and D19; every fifth case lost its filing date."""
    rows = views.filed_texts(spark, folder).join(views.cases(spark, folder, "id", "processed_at"), "id")
    rows = rows.withColumn("date", F.when(F.col("id") % 5 != 0, F.col("date")))
    _, alerts, summary = plan.process_pending(rows, views.AS_OF, threshold=THRESHOLD)
    listed = alerts.agg(F.coalesce(F.min((F.col("count") >= rootcause.MIN_CLUSTER).cast("int")), F.lit(1)).alias("alerts_listed"))
    return summary.select("processed", "errors", listed.scalar().alias("alerts_listed"))


@query("l2_error_channel", over(CASES) + """,
broken AS (SELECT id, id % 5 = 0 OR date IS NULL AS d, id % 7 = 0 AS a, vec_id IS NOT NULL AND (id % 11 = 0 OR id % 13 = 0) AS v
  FROM cases LEFT JOIN embeddings ON vec_id = id WHERE processed_at IS NULL)
SELECT 'deadline' AS stage, 'date' AS "column", 'unreadable filing date' AS reason, COUNT(*) AS cases FROM broken WHERE d HAVING COUNT(*) > 0
UNION ALL SELECT 'severity', 'amount_involved', 'unreadable amount', COUNT(*) FROM broken WHERE a HAVING COUNT(*) > 0
UNION ALL SELECT 'duplicates', 'embedding', 'unusable vector', COUNT(*) FROM broken WHERE v HAVING COUNT(*) > 0
UNION ALL SELECT 'any', 'any', 'any', COUNT(*) FROM broken WHERE d OR a OR v""")
def error_channel(spark, folder):
    """L2 on rows broken in four ways: dates and amounts that are no such thing, vectors with a missing component, vectors cut short."""
    rows = views.filed_texts(spark, folder).join(views.cases(spark, folder, "id", "processed_at"), "id")
    vector, id_ = F.col("embedding"), F.col("id")
    holed = F.transform(vector, lambda x, i: F.when(i > 0, x))
    broken = rows.withColumns({
        "date": F.when(id_ % 5 == 0, "2001-13-45").otherwise(F.col("date").cast("string")),
        "amount_involved": F.when(id_ % 7 == 0, "twelve").otherwise(F.col("amount_involved").cast("string")),
        "embedding": F.when(id_ % 11 == 0, holed).when(id_ % 13 == 0, F.slice(vector, 1, 3)).otherwise(vector),
    })
    done, _, summary = plan.process_pending(broken, views.AS_OF, with_alerts=False, threshold=THRESHOLD)
    any_ = summary.select(*[F.lit("any").alias(c) for c in ("stage", "column", "reason")], F.col("errors").alias("cases"))
    return kpi.error_summary(done).unionByName(any_)
