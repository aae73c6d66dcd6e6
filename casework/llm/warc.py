"""Content-addressed web archive: payload bytes once per SHA-256, exact record headers apart, records by a join.

An archive is a folder with two Parquet tables. `payloads` (digest, length, payload, first_id) has one row per distinct
payload. `headers` (digest, header) has one row per record with the header block of its WARC/1.1 record, CRLF line ends and the
empty line included. `read_archive` parses the header blocks, joins the payloads, and fails on a digest or length that does
not agree.

Defined cases: a null payload is the empty payload, a null or empty URL gives no WARC-Target-URI line, CR and LF in a URL are
percent-encoded. Of equal payloads with `least` bytes or more the smallest id is the response, also when its row is repeated
(each such row is a response); rows without an id refer to it like any other, and are all responses if no row of the
group has an id. An empty table gives an empty archive. Columns other than the three named are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAYLOADS = "digest string, length long, payload binary, first_id long"
HEADERS = "digest string, header binary"


def _records(pages: DataFrame, key: str, payload: str, uri: str) -> DataFrame:
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", uri: str = "url",
                  least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the two tables. `date` is the capture time of all records; nothing reads the clock.

    Copies meet in the partial aggregation, so a payload leaves each task at most once however often it occurs. A second hash
    and the length must agree within a digest, else the job fails.
    """
    spark = pages.sparkSession
    rows = _records(pages, key, payload, uri)
    second = F.xxhash64("payload")
    store = rows.groupBy("digest").agg(
        F.min("length").alias("length"), F.max("length").alias("longest"), F.min(second).alias("low"), F.max(second).alias("high"),
        F.first("payload").alias("payload"), F.min("id").alias("first_id"),
    )
    same = (F.col("length") == F.col("longest")) & (F.col("low") == F.col("high"))
    checked = F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads share digest "), "digest")))
    store.select("digest", "length", checked.cast("binary").alias("payload"), "first_id").write.parquet(f"{folder}/payloads")

    firsts = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select("digest", "first_id")
    rows = rows.select("id", "uri", "digest", "length").join(firsts, "digest")
    revisit = (F.col("length") >= least) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    encoded = F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.when(F.col("uri") != "", F.concat(F.lit("WARC-Target-URI: "), encoded)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("length")).cast("string")),
        F.lit("\r\n"),
    )
    rows.select("digest", F.encode(lines, "UTF-8").alias("header")).write.parquet(f"{folder}/headers")


def _field(block: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(block, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: id, uri, record_type, refers_to, payload, payload_digest, payload_bytes, record.

    `payload` is the full payload, of a revisit the one it refers to; `record` is the original record: header block, its own
    content (none for a revisit) and the closing empty lines.
    """
    headers = spark.read.schema(HEADERS).parquet(f"{folder}/headers")
    store = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select("digest", "length", "payload")
    block = F.decode("header", "UTF-8")
    parsed = headers.select(
        "digest", "header",
        F.regexp_extract(_field(block, "WARC-Record-ID"), r"^<urn:page:(-?[0-9]+)>$", 1).alias("id_text"),
        _field(block, "WARC-Target-URI").alias("uri"), _field(block, "WARC-Type").alias("record_type"),
        F.regexp_extract(_field(block, "WARC-Refers-To"), r"^<urn:page:(-?[0-9]+)>$", 1).alias("refers_text"),
        F.regexp_extract(_field(block, "WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("stated"),
        _field(block, "Content-Length").cast("long").alias("content"),
    )
    joined = parsed.join(store, "digest", "left").withColumn("found", F.sha2("payload", 256))
    due = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.octet_length("payload"))
    good = (F.col("found") == F.col("stated")) & (F.col("length") == F.octet_length("payload")) & (F.col("content") == due)
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        F.nullif("id_text", F.lit("")).cast("long").alias("id"), "uri", "record_type",
        F.nullif("refers_text", F.lit("")).cast("long").alias("refers_to"),
        "payload", F.when(good, F.col("found")).otherwise(F.raise_error(F.concat(F.lit("bad record under "), "digest")))
        .cast("string").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"),
    )
