"""Session construction and the one place that knows about checkpoint storage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "casework", cpus: int | str = "*", shuffle_partitions: int | None = None,
                checkpoint_dir: str | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session to every function.

    `checkpoint_dir` is where intermediate tables go; without it a job that needs one fails.
    """
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Where it is unset a local session, as in tests, gets a temporary folder; on a cluster that is an error, because a
    machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = os.path.join(tempfile.mkdtemp(prefix="casework-"), "checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def table_path(spark: SparkSession) -> str:
    """Path of a new intermediate table; `owned_tables` can remove it."""
    path = f"{ensure_checkpoint_dir(spark)}/casework-{uuid.uuid4().hex}"
    for tables in getattr(_OWNERS, "lists", ()):
        tables.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame as a Parquet table in the shared checkpoint folder and read it back.

    Unlike an RDD checkpoint the table keeps column pruning, filter push-down and real sizes for join planning,
    and a lost executor costs a re-read, not a recomputation.
    """
    path = table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_OWNERS = threading.local()


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that this thread makes inside; what depends on them must be written by then."""
    tables: list[str] = []
    _OWNERS.lists = [*getattr(_OWNERS, "lists", ()), tables]
    try:
        yield
    finally:
        _OWNERS.lists = _OWNERS.lists[:-1]
        jvm = spark.sparkContext._jvm
        for path in tables:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
