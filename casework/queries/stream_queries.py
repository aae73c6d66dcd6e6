"""Streaming queries: each runs a real stream over a driver table and returns the sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casework.queries.base import STRIKES, over, query
from casework.session import ensure_checkpoint_dir
from casework.sources import views
from casework.streaming import intake, ratelimit

LIMIT_SQL = """
WITH RECURSIVE opened AS (
  SELECT user_id, MIN(ts) AS o FROM events GROUP BY 1
  UNION ALL
  SELECT p.user_id, (SELECT MIN(e.ts) FROM events e WHERE e.user_id = p.user_id AND e.ts {op} p.o + INTERVAL 24 HOUR) AS o
  FROM opened p WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.ts {op} p.o + INTERVAL 24 HOUR)),
placed AS (SELECT event_id, user_id, ts, (SELECT MAX(o) FROM opened p WHERE p.user_id = e.user_id AND o <= ts) AS o FROM events e),
turns AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, o ORDER BY ts, event_id) AS turn FROM placed)
SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS client, turn <= 3 AS accepted,
  CASE WHEN turn > 3 THEN CAST(ceil((86400000000 - date_diff('microsecond', o, ts)) / 3600000000.0) AS BIGINT) END AS hours_left FROM turns"""


@query("i4_rate_limit", LIMIT_SQL.format(op=">="))
def rate_limit(spark, folder):
    """I4 and I8 over the whole request log."""
    return ratelimit.limit_batch(views.requests(spark, folder)).drop("at")


@query("i5_rate_limit_strict", LIMIT_SQL.format(op=">"))
def rate_limit_strict(spark, folder):
    return ratelimit.limit_batch(views.requests(spark, folder), strict=True).drop("at")


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, folder):
    """The event table as a file stream. The schema comes from the file, as a stream does not infer it."""
    schema = views.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query("i4_rate_limit_stream", LIMIT_SQL.format(op=">="))
def rate_limit_stream(spark, folder):
    requests = _event_stream(spark, folder).select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("client"), F.col("ts").alias("at")
    )
    where = _scratch(spark)
    return intake.run_to_table(ratelimit.limit_stream(requests), f"{where}/out", f"{where}/checkpoint").drop("at")


@query("i6_once_per_id", "SELECT user_id, 1::BIGINT AS kept, 1 AS own FROM events GROUP BY 1")
def once_per_id(spark, folder):
    """One event of every user, of the user's own; the others within the watermark are retries."""
    events = _event_stream(spark, folder).select("user_id", "event_id", "ts")
    where = _scratch(spark)
    out = intake.run_to_table(intake.once_per_id(events, "user_id", "ts", "60 days"), f"{where}/out", f"{where}/checkpoint")
    own = views.table(spark, folder, "events").select("event_id", F.col("user_id").alias("owner"))
    checked = out.join(own, "event_id", "left").withColumn("own", F.col("user_id").eqNullSafe(F.col("owner")).cast("int"))
    return checked.groupBy("user_id").agg(F.count("*").alias("kept"), F.min("own").alias("own"))


@query("d20_strikes_per_day_stream", over(STRIKES) + """
SELECT account_number, CAST(created_at AS DATE) AS day, COUNT(*) AS strikes FROM strikes GROUP BY 1, 2""")
def strikes_per_day_stream(spark, folder):
    """All account-days, open ones included: update mode into a keyed table."""
    strikes = _event_stream(spark, folder).where(F.col("event_type") == "error").select(
        F.col("user_id").cast("string").alias("account_number"), F.col("ts").alias("created_at")
    )
    where = _scratch(spark)
    return intake.run_updates_to_table(
        intake.strikes_per_day(strikes), f"{where}/out", f"{where}/checkpoint", ["account_number", "day"], "strikes"
    )


@query("i7_live_counts", "SELECT event_type AS status, COUNT(*) AS cases FROM events GROUP BY 1")
def live_counts(spark, folder):
    """A complete-mode aggregate into a table that each trigger replaces, as the dashboard polls it."""
    counts = intake.live_counts(_event_stream(spark, folder).select(F.col("event_type").alias("status")))
    where = _scratch(spark)
    return intake.run_complete_to_table(counts, f"{where}/out", f"{where}/checkpoint")
