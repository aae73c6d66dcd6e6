"""Registry of queries: each has a Spark callable and, where SQL can state it, an independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


# The views of casework.sources.views, stated once more in ANSI SQL for the oracle.
CASES = """
cases AS (
  SELECT b.*,
    CASE WHEN status <> 'open' THEN date + CAST(id % 40 AS INTEGER) END AS resolved_at,
    CASE WHEN status = 'auto_resolved_dup' THEN id - 1 END AS duplicate_of,
    CASE WHEN id % 17 <> 0 THEN date END AS processed_at,
    date + sla_days AS sla_due_date,
    CASE WHEN id % 17 <> 0 THEN CAST(id * 37 % 101 AS DOUBLE) / 100 END AS sla_breach_prob,
    CAST(id * 29 % 101 AS INTEGER) AS risk_score,
    CAST(id * 53 % 101 AS INTEGER) AS priority_score,
    CASE WHEN id % 4 <= 1 THEN 'High Confidence' WHEN id % 4 = 2 THEN 'Needs Review' END AS category_confidence
  FROM (
    SELECT c.*,
      GREATEST(1, CAST(round_even(
        CAST(CASE category WHEN 'UPI' THEN 5 WHEN 'ATM' THEN 5 WHEN 'Card' THEN 7 WHEN 'NetBanking' THEN 7 ELSE 30 END AS DOUBLE)
        * CAST(CASE severity WHEN 'Critical' THEN 0.5 WHEN 'High' THEN 0.7 WHEN 'Low' THEN 1.2 ELSE 1.0 END AS DOUBLE), 0)
        AS INTEGER)) AS sla_days
    FROM (
      SELECT o_orderkey AS id, c_name AS customer_name, CAST(o_custkey AS VARCHAR) AS account_no,
        CASE WHEN o_orderkey % 4 = 0 THEN lower(c_name) || '@example.com' END AS customer_email,
        n_name || '#' || CAST(c_custkey % 40 AS VARCHAR) AS location,
        DATE '2001-05-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 92 AS INTEGER) AS date,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 4 END AS amount_involved,
        CASE o_orderkey % 7 WHEN 0 THEN 'email' WHEN 1 THEN 'whatsapp' WHEN 2 THEN 'twitter' WHEN 3 THEN 'branch'
          WHEN 4 THEN 'bank_portal' WHEN 5 THEN 'phone_call' ELSE 'mobile_app' END AS channel,
        CASE o_orderkey % 3 WHEN 0 THEN 'english' WHEN 1 THEN 'hindi' ELSE 'marathi' END AS language,
        CASE o_orderkey % 5 WHEN 0 THEN 'savings' WHEN 1 THEN 'current' WHEN 2 THEN 'credit_card'
          WHEN 3 THEN 'loan' ELSE 'demat' END AS account_type,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CASE o_orderkey % 6 WHEN 0 THEN 'UPI' WHEN 1 THEN 'ATM'
          WHEN 2 THEN 'Card' WHEN 3 THEN 'Loan' WHEN 4 THEN 'NetBanking' ELSE 'General' END END AS category,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium'
          WHEN '5' THEN 'Low' END AS severity,
        CASE o_orderkey % 5 WHEN 0 THEN 'Angry' WHEN 1 THEN 'Frustrated' WHEN 2 THEN 'Neutral' WHEN 3 THEN 'Polite' END
          AS sentiment,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE CASE o_orderkey % 3
          WHEN 0 THEN 'auto_resolved_dup' WHEN 1 THEN 'auto_resolved_std' ELSE 'escalated' END END AS status
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    ) c
  ) b
)"""

VECTORS = """
vectors AS (
  SELECT vec_id AS id, 'label' || CAST(label AS VARCHAR) AS customer_name,
    CASE WHEN vec_id % 19 <> 0 THEN CASE label % 6 WHEN 0 THEN 'UPI' WHEN 1 THEN 'ATM' WHEN 2 THEN 'Card'
      WHEN 3 THEN 'Loan' WHEN 4 THEN 'NetBanking' ELSE 'General' END END AS category,
    CASE WHEN vec_id % 7 <> 0 THEN 'city' || CAST(vec_id % 9 AS VARCHAR) END AS location,
    CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings
)"""

STRIKES = """
strikes AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS account_number, ts AS created_at
  FROM events WHERE event_type = 'error'
)"""

REVIEWS = """
reviews AS (
  SELECT doc_id * 2 AS id, doc_id AS complaint_id, 'category' AS field,
    CASE doc_id % 6 WHEN 0 THEN 'UPI' WHEN 1 THEN 'ATM' WHEN 2 THEN 'Card' WHEN 3 THEN 'Loan' WHEN 4 THEN 'NetBanking'
      ELSE 'General' END AS original_value,
    CASE WHEN quality = 0 THEN CASE (doc_id + 1) % 6 WHEN 0 THEN 'UPI' WHEN 1 THEN 'ATM' WHEN 2 THEN 'Card'
      WHEN 3 THEN 'Loan' WHEN 4 THEN 'NetBanking' ELSE 'General' END END AS corrected_value,
    quality = 1 AS is_correct,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 2 % 50) AS created_at
  FROM labels
  UNION ALL
  SELECT doc_id * 2 + 1, doc_id - doc_id % 3, 'severity', 'Medium',
    CASE WHEN toxic = 1 THEN 'High' WHEN doc_id % 2 = 0 THEN 'Low' END,
    toxic = 0 AND doc_id % 2 = 1,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 2 + 1) % 50)
  FROM labels
)"""


def over(*views: str) -> str:
    return "WITH " + ",".join(v.strip() for v in views) + "\n"
