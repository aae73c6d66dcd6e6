"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from casework.queries import QUERIES
from casework.session import get_session

HEADLINES = (
    "l1_enrichment", "l5_compliance_report", "j2_duplicates", "e3_neighbours", "d2_kpi_strip", "d1_service_stats",
    "d13_report_summary", "d9_top_cities", "d10_resolution_breakdown", "d16_alert_conditions", "b2_queue", "l4_customer_view",
    "k19_recompute_risk", "k1_sla_features", "a5_insert_if_absent", "a16_allocate_ids", "c8_apply_corrections",
    "h1_keyword_category", "p1_masked_text", "p2_numbered_tokens", "a4_mail_cases", "i4_rate_limit",
    "i4_rate_limit_stream", "i1_mail_ingest", "j4_clusters", "k14_category_predictions",
)
ROWS_PER_SECOND = ("l1_enrichment", "l5_compliance_report", "d2_kpi_strip", "k19_recompute_risk")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINES
    spark = get_session("bench", cpus, int(cpus) if cpus.isdigit() else None)
    # Start the JVM's code paths and the Python workers outside the timed part.
    QUERIES["d3_per_day"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    cases = spark.read.parquet(f"{folder}/orders.parquet").count()
    scale = re.search(r"sf([0-9.]+)", folder)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
        "cases": cases,
        "cases_per_sec": {n: round(cases / seconds[n]) for n in ROWS_PER_SECOND if n in seconds},
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
