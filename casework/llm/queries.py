"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm import (
    alignment, chat, decontamination, licences, negatives, packing, pii_scan, quality, secret_scan, sharding, simhash, templates, warc,
)
from casework.llm.common import kind_count, of_kinds, scratch, span_list, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


OP3_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\.\2', 'g') AS role_out,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\.\2', 'g') AS text_out
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(17 + length(role_out) + length(text_out)) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


@query("op3_chat_formatting", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is full of control strings."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.format_records(chat.records_of_turns(turns)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"), *[kind_count(F.col("spans"), k).alias(f"n_{k}") for k in base],
        F.sha2(span_list(of_kinds(F.col("spans"), base)).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secret_scan.scan(table(spark, sf_dir, "documents")), secret_scan.BASE)


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii_scan.scan(table(spark, sf_dir, "documents")), pii_scan.BASE)


OP10_SQL = """
WITH records AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM records
), kinds AS (
  SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM firsts
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to
FROM kinds
"""


@query("op10_web_archive", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archive, read it back."""
    folder = scratch(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op2_simhash_pivots")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_vector_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens", F.col("digest").alias("group_digest"),
    )


@query("op8_sum_of_squares")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return placed.withColumnRenamed("id", "doc_id")


OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), numbered AS (
  SELECT *, row_number() OVER () AS r FROM words
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM numbered WHERE len(w) > 2)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY r
), split_ AS (
  SELECT host, text, unnest(string_split(regexp_replace(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT DISTINCT host, text FROM docs)
), trimmed AS (
  SELECT host, text, pos, trim(line, ' ') AS line FROM split_ WHERE trim(line, ' ') <> ''
), frequent AS (
  SELECT host, line FROM trimmed GROUP BY host, line HAVING count(DISTINCT text) > 10
), removed AS (
  SELECT t.host, t.text, count(*) AS removed_lines, sum(len(t.line) - len(replace(t.line, ' ', '')) + 1) AS removed_words
  FROM trimmed t JOIN frequent f ON t.host = f.host AND t.line = f.line GROUP BY t.host, t.text
), counted AS (
  SELECT n.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(n.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(d.removed_lines, 0) AS removed_lines, CAST(coalesce(d.removed_words, 0) AS BIGINT) AS removed_words
  FROM numbered n LEFT JOIN covered c ON n.r = c.r LEFT JOIN removed d ON n.host = d.host AND n.text = d.text
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND NOT n_words - removed_words < n_words * CAST(0.5 AS DOUBLE) AS kept FROM judged
"""


@query("op7_line_frequency", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdicts(table(spark, sf_dir, "documents"))
    return rows.drop(*quality.TEXT).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH texts AS (
  SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM texts
), widths AS (
  SELECT DISTINCT least(len(w), 5) AS n FROM words WHERE kind = 'item' AND len(w) > 0
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (
    SELECT kind, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (
      SELECT kind, id, w, least(len(w), 5) AS n FROM words WHERE kind = 'item' AND len(w) > 0
      UNION ALL SELECT kind, id, w, n FROM words JOIN widths ON len(w) >= n WHERE kind = 'doc'
    )
  )
), sizes AS (
  SELECT id, count(*) AS item_shingles FROM shingles WHERE kind = 'item' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared
  FROM (SELECT * FROM shingles WHERE kind = 'doc') d JOIN (SELECT * FROM shingles WHERE kind = 'item') i ON d.s = i.s GROUP BY 1, 2
)
SELECT doc_id, item_id, shared, item_shingles, CAST(shared AS DOUBLE) / item_shingles AS containment
FROM shared JOIN sizes ON item_id = id WHERE shared * 100 >= item_shingles * 80
"""


@query("op9_containment_search", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


#: Where a document lies: source/language/block of a hundred; every tenth id of a folder is its licence file.
DOC_PATH = """concat_ws('/', coalesce(source, ''), CASE WHEN doc_id % 1000 = 0 THEN 'LICENSE.' || doc_id
  ELSE concat_ws('/', coalesce(lang, ''), CASE WHEN doc_id % 100 = 0 THEN 'LICENSE.' || doc_id
  ELSE CAST(doc_id - doc_id % 100 AS STRING) || '/' || CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END END) END)"""


@query("op1_licence_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{DOC_PATH} AS path")
    return licences.scan(files).withColumnRenamed("id", "doc_id")


@query("op11_template_slots")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.main_texts(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
    )
    return aligned.withColumnRenamed("id", "doc_id")


OP13_SQL = """
WITH sound AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.id <> b.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.whole_numbers(rows.withColumn("label", moved), "vec_id", "embedding", "label")
    return negatives.mine(vectors, F.col("id") % 100 == 0)
