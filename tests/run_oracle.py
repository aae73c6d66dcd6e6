"""Compare registered queries with their oracles: python -m tests.run_oracle [scale] [name part ...]."""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import SparkSession

from casework.queries import ORACLES, QUERIES
from casework.session import get_session
from tests.oracle import compare, connect


def main() -> int:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    if os.environ.get("PLAIN_SESSION"):
        # A session with Spark's own defaults, as a foreign driver would pass it.
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_session("oracle", 8, 8)
    con = connect(folder)
    failed = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, fn, ORACLES[name], folder)
            else:
                problem = None if fn(spark, folder).count() >= 0 else "no result"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "oracle" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok':5s}{kind:7s}{time.time() - start:7.2f}s  {name}  {problem or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
