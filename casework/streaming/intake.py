"""Incremental ingest and live aggregates: I1, I2, I3, I6, I7."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from casework import schemas
from casework.operators import kpi, store
from casework.operators.strikes import STRIKES_TO_BLOCK
from casework.plans import enrich as plan
from casework.session import cut_lineage, owned_tables
from casework.sources import mail

FILES_PER_TRIGGER = 5
POLL = "30 seconds"
BUCKETS = 1024
_RAW = (*schemas.RAW_CASE.names, "embedding")
_HISTORY = T.StructType(
    [schemas.CASE[n] for n in ("id", "customer_name", "category", "sentiment", "status", "channel", "date", "embedding")]
)
Vectoriser = Callable[[Column], Column]


def mail_source(spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Decoded mail as JSON lines. An unreadable line arrives in `_broken` instead of failing the trigger."""
    schema = T.StructType([*schemas.MAIL.fields, T.StructField("_broken", T.StringType())])
    return (
        spark.readStream.schema(schema)
        .option("columnNameOfCorruptRecord", "_broken")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )


def once_per_id(stream: DataFrame, key: str, at: str, delay: str = "2 days") -> DataFrame:
    """A retried record within the watermark is dropped; its state expires with the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")


def append_buckets(rows: DataFrame, path: str, key: str) -> None:
    """Append rows under the bucket of their key's digest."""
    rows.withColumn("bucket", _bucket(key)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def in_buckets(spark: SparkSession, path: str, schema: T.StructType, asked: DataFrame, key: str) -> DataFrame:
    """Stored rows in the buckets of the asked keys; the other folders are neither listed nor opened. The list has `BUCKETS` numbers at most.

    None of these folders yet means no rows; any other error is raised.
    """
    wanted = [r["b"] for r in asked.select(_bucket(key).alias("b")).distinct().collect()]
    stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    if not wanted:
        return spark.createDataFrame([], schema)
    folders = f"{path}/bucket={{{','.join(map(str, sorted(wanted)))}}}"
    try:
        rows = spark.read.schema(stored).option("basePath", path).parquet(folders)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.drop("bucket")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The ingested case table."""
    return spark.read.schema(schemas.CASE).parquet(path)


def unseen(batch: DataFrame, path: str, key: str = "id") -> DataFrame:
    """A5 for a micro-batch: one row per id the table lacks. A replayed trigger finds its ids and adds nothing."""
    fresh = cut_lineage(store.first_per_key(batch.where(F.col(key).isNotNull()), key, ["date"]))
    ids = T.StructType([fresh.schema[key]])
    return fresh.join(in_buckets(batch.sparkSession, path, ids, fresh, key), key, "left_anti")


def start_mail_ingest(mails: DataFrame, table: str, quarantine: str, checkpoint: str, as_of, trigger: dict | None = None,
                      enrich: bool = True, history: str | None = None, vectors: Vectoriser | None = None, **options) -> StreamingQuery:
    """I1 + I2: each trigger turns its mail into enriched cases, once per mail id.

    The case table lies in buckets of the id's digest, and a narrow history table (`history`, by default beside the table) in
    buckets of the customer's, with the columns that duplicates and histories need. A trigger reads the buckets of its own
    ids and customers only, whatever the table has grown to. New cases are compared with the stored ones and share their
    customers' histories; `vectors` makes the embedding column from the text column, where mails come without.
    Broken lines go to a `quarantine` folder per trigger, so one bad record neither blocks the stream nor is read again, and a
    retried trigger replaces what it wrote. The streaming checkpoint takes the place of the "seen" mark. `options` are those
    of `enrich`, fitted models among them.
    """
    past = history or f"{table}-history"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            with owned_tables(batch.sparkSession):
                append(batch, batch_id)
        finally:
            batch.unpersist()

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.where(F.col("_broken").isNotNull()).select("_broken").write.mode("overwrite").json(f"{quarantine}/batch_id={batch_id}")
        raw = mail.normalise(batch.where(F.col("_broken").isNull()), as_of).withColumnRenamed("mail_id", "id")
        fresh = unseen(schemas.conform(raw, schemas.CASE), table)
        if vectors is not None:
            fresh = fresh.withColumn("embedding", vectors(F.col("complaint_text")))
        if enrich:
            fresh = cut_lineage(fresh)
            known = in_buckets(spark, past, _HISTORY, fresh, "customer_name").dropDuplicates(["id"])
            known = known.join(fresh.select("id"), "id", "left_anti")
            kept = fresh.select("id", "complaint_text", "embedding")
            done = plan.enrich(fresh.select(*_RAW), as_of, known=known, **options)
            fresh = cut_lineage(schemas.conform(done.join(kept, "id"), schemas.CASE))
        # History first: after a failure between the two the ids are still unseen, and histories drop repeated ids.
        append_buckets(schemas.conform(fresh, _HISTORY), past, "customer_name")
        append_buckets(fresh, table, "id")

    writer = mails.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": POLL})).start()


def strikes_per_day(strikes: DataFrame, delay: str = "2 days") -> DataFrame:
    """D20 as a stream: strikes per account and calendar day, state dropped after the watermark."""
    events = strikes.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    counted = events.groupBy("account_number", F.window("created_at", "1 day")).agg(F.count("*").alias("strikes"))
    return counted.select("account_number", F.col("window.start").cast("date").alias("day"), "strikes")


def blocked_accounts(strikes: DataFrame, threshold: int = STRIKES_TO_BLOCK, delay: str = "2 days") -> DataFrame:
    """I3 as a stream (update mode): account-days that have reached the threshold."""
    return strikes_per_day(strikes, delay).where(F.col("strikes") >= threshold)


def live_counts(cases: DataFrame) -> DataFrame:
    """Status counts for a complete-mode sink that a dashboard polls."""
    return kpi.counts(cases, F.coalesce("status", F.lit("open")), "status")


def run_updates_to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], value: str) -> DataFrame:
    """Run an update-mode count over everything available into a keyed table and return it, open groups included.

    Each trigger writes its changed groups to a folder of its own, which a retried trigger replaces; a count only grows, so the
    largest one of a key is the last.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch_id=*").groupBy(*keys).agg(F.max(value).alias(value))


def run_complete_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a complete-mode aggregate over everything available; each trigger replaces the table."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
        .option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a Parquet table and return the table."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
