"""Text rule, masking and intake queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.functions import labels, pii, text
from casework.queries.base import CASES, over, query
from casework.sources import mail, portal, views
from casework.sources.views import cases, table

KEYWORD_SQL = r"""CASE WHEN regexp_matches(text, '(?i)upi') THEN 'UPI' WHEN regexp_matches(text, '(?i)\bATM\b|cash.{0,15}machine') THEN 'ATM'
  WHEN regexp_matches(text, '(?i)credit.?card|debit.?card|\bcard\b') THEN 'Card'
  WHEN regexp_matches(text, '(?i)\bloan\b|EMI|home.?loan|personal.?loan') THEN 'Loan'
  WHEN regexp_matches(text, '(?i)net.?banking|mobile.?banking|internet.?banking') THEN 'NetBanking' ELSE 'General' END"""
SEVERITY_SQL = r"""CASE WHEN n_chars * 20 >= 50000 THEN 'Critical'
  WHEN regexp_matches(text, '(?i)unauthor|fraud|stuck|debit.{0,15}fail|debited') THEN 'High'
  WHEN n_chars > 0 AND n_chars % 2 = 0 THEN 'Medium' ELSE 'Low' END"""
SENTIMENT_SQL = r"""CASE WHEN regexp_matches(text, '(?i)unacceptable|disgust|outrage|terrible|worst|!!') THEN 'Angry'
  WHEN regexp_matches(text, '(?i)kindly|please|would you|appreciate|sir/madam|कृपया') THEN 'Polite'
  WHEN contains(text, '!') OR contains(text, '?') THEN 'Frustrated' ELSE 'Neutral' END"""


@query("h1_keyword_category", f"SELECT doc_id, {KEYWORD_SQL} AS category FROM documents")
def keyword_category(spark, folder):
    docs, scanned = text.scan(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", text.keyword_category(scanned).alias("category"))


@query("h2_weak_category", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(upi|paytm|gpay|google pay|phonepe|bhim)\b') THEN 'UPI'
  WHEN regexp_matches(text, '(?i)\batm\b|cash.{0,15}machine|दिखाई नहीं|कैश मशीन') THEN 'ATM'
  WHEN regexp_matches(text, '(?i)credit.?card|debit.?card|\bcard\b|कार्ड') THEN 'Card'
  WHEN regexp_matches(text, '(?i)\bloan\b|emi|home.?loan|personal.?loan|ऋण') THEN 'Loan'
  WHEN regexp_matches(text, '(?i)net.?banking|mobile.?banking|internet.?banking|netbanking|mobile app') THEN 'NetBanking'
  ELSE 'General' END AS category FROM documents""")
def weak_category(spark, folder):
    docs, scanned = text.scan(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", text.weak_category(scanned).alias("category"))


@query("h3_substring_category", """
SELECT doc_id, CASE WHEN contains(t, 'upi') THEN 'UPI' WHEN contains(t, 'atm') THEN 'ATM' WHEN contains(t, 'card') THEN 'Card'
  WHEN contains(t, 'loan') OR contains(t, 'emi') THEN 'Loan'
  WHEN contains(t, 'net banking') OR contains(t, 'mobile banking') OR contains(t, 'internet banking') OR contains(t, 'netbanking')
  THEN 'NetBanking' ELSE 'General' END AS category FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def substring_category(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.lower("text").alias("text"))
    return docs.select("doc_id", text.substring_category(F.col("text")).alias("category"))


@query("h4_h5_labels", f"SELECT doc_id, {SEVERITY_SQL} AS severity, {SENTIMENT_SQL} AS sentiment FROM documents")
def rule_labels(spark, folder):
    docs, scanned = text.scan(table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "text")
    amount = F.when(F.col("n_chars") * 20 >= 50000, 50000.0).when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("double"))
    return docs.select("doc_id", text.severity_rule(scanned, amount).alias("severity"),
                       text.sentiment_rule(scanned).alias("sentiment"))


@query("h6_language_tags", """
SELECT doc_id, CASE WHEN contains(t, chr(2304)) THEN 'hindi' WHEN contains(t, 'आहे') THEN 'marathi' WHEN contains(t, 'माझ्') THEN 'marathi'
  WHEN contains(t, chr(2305)) THEN 'hindi' ELSE 'english' END AS by_hint,
  CASE WHEN contains(t, 'आहे') OR contains(t, 'माझ्') THEN 'marathi' WHEN regexp_matches(t, '[\\x{0900}-\\x{097F}]') THEN 'hindi' ELSE 'english' END AS by_script
FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' समस्या आहे' WHEN 1 THEN ' कृपया' WHEN 2 THEN ' पैसे नहीँ' ELSE '' END AS t FROM documents)""")
def language_tags(spark, folder):
    key = F.col("doc_id") % 5
    suffix = F.when(key == 0, " समस्या आहे").when(key == 1, " कृपया").when(key == 2, " पैसे नहीँ").otherwise("")
    docs = table(spark, folder, "documents").select("doc_id", F.concat("text", suffix).alias("text"))
    return docs.select("doc_id", text.language_tag(F.col("text")).alias("by_hint"),
                       text.language_tag(F.col("text"), "script").alias("by_script"))


@query("h7_amounts", r"""
SELECT doc_id, COALESCE(
  TRY_CAST(replace(regexp_extract(t, '(?i)(?:Rs\.?|₹|INR)\s*([0-9,]+(?:\.[0-9]{1,2})?)', 1), ',', '') AS DOUBLE),
  TRY_CAST(replace(regexp_extract(t, '(?i)([0-9,]+(?:\.[0-9]{1,2})?)\s*(?:rupees?|/-)', 1), ',', '') AS DOUBLE)) AS amount
FROM (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' Rs. 1,' || CAST(100 + doc_id % 900 AS VARCHAR) || '.50 lost'
  WHEN 1 THEN ' ₹' || CAST(doc_id AS VARCHAR) WHEN 2 THEN ' paid ' || CAST(doc_id AS VARCHAR) || '/-' WHEN 3 THEN ' rs , then 70 rupees' ELSE '' END AS t
  FROM documents)""")
def amounts(spark, folder):
    key, number = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    suffix = (
        F.when(key == 0, F.concat(F.lit(" Rs. 1,"), (100 + F.col("doc_id") % 900).cast("string"), F.lit(".50 lost")))
        .when(key == 1, F.concat(F.lit(" ₹"), number))
        .when(key == 2, F.concat(F.lit(" paid "), number, F.lit("/-")))
        .when(key == 3, " rs , then 70 rupees")
        .otherwise("")
    )
    docs = table(spark, folder, "documents").select("doc_id", F.concat("text", suffix).alias("text"))
    docs, scanned = text.scan(docs, "text")
    return docs.select("doc_id", text.amount_from_text(scanned).alias("amount"))


def _city_sql(column: str) -> str:
    whens = " ".join(f"WHEN contains({column}, '{c.lower()}') THEN '{c}'" for c in text.KNOWN_CITIES)
    return f"CASE {whens} END"


@query("h8_city_tags", f"""
SELECT doc_id, {_city_sql('t')} AS city FROM (
  SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' near AGRA and Pune' WHEN 1 THEN ' in Thane' ELSE '' END) AS t FROM documents)""")
def city_tags(spark, folder):
    key = F.col("doc_id") % 4
    suffix = F.when(key == 0, " near AGRA and Pune").when(key == 1, " in Thane").otherwise("")
    docs = table(spark, folder, "documents").select("doc_id", F.lower(F.concat("text", suffix)).alias("lowered"))
    return docs.select("doc_id", text.city_tag(F.col("lowered")).alias("city"))


@query("h9_canonical_labels", """
SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#1' THEN 'Brand#1' WHEN lower(p_brand) = 'brand#2' THEN 'Brand#2'
  WHEN contains(lower(p_brand), 'brand#1') THEN 'Brand#1' WHEN contains(lower(p_brand), 'brand#2') THEN 'Brand#2' ELSE 'Other' END AS label
FROM part""")
def canonical_labels(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.upper("p_brand").alias("label"))
    return parts.select("p_partkey", text.canonical_label(F.col("label"), ("Brand#1", "Brand#2"), "Other").alias("label"))


@query("h10_h11_text_features", r"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS words,
  CAST(regexp_matches(lower(text), 'unauthor|fraud|stolen|hack|scam|stuck|debited') AS INTEGER) AS fraud FROM documents""")
def text_features(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("lowered", F.lower("text"))
    body = F.col("text")
    return docs.select("doc_id", text.text_length(body).alias("chars"), text.word_count(body).alias("words"),
                       text.fraud_flag(F.col("lowered")).alias("fraud"))


@query("h12_h13_filing_features", over(CASES) + """
SELECT id, CAST(isodow(date) - 1 AS INTEGER) AS weekday, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS weekend,
  CAST(DATE '2001-08-01' - date AS DOUBLE) * 24 AS hours,
  round(CAST(DATE '2001-08-01' - date AS DOUBLE) * 24 / (sla_days * 24.0::DOUBLE), 6) AS share FROM cases""")
def filing_features(spark, folder):
    from casework.functions import sla

    rows = cases(spark, folder, "id", "date", "category", "severity")
    hours = sla.hours_since(F.col("date"), views.AS_OF)
    weekday = sla.weekday(F.col("date"))
    share = sla.sla_share_elapsed(hours, sla.sla_days(F.col("category"), F.col("severity")))
    return rows.select("id", weekday.alias("weekday"), (weekday >= 5).cast("int").alias("weekend"), hours.alias("hours"),
                       F.round(share, 6).alias("share"))


@query("h26_resolution", over(CASES) + """
SELECT id, CASE WHEN duplicate_of IS NOT NULL THEN 'auto_resolved_dup'
  WHEN severity IN ('Low', 'Medium') AND sentiment = 'Polite' AND category IS NOT NULL THEN 'auto_resolved_std' ELSE 'open' END AS status
FROM cases""")
def resolution(spark, folder):
    rows = cases(spark, folder, "id", "duplicate_of", "category", "severity", "sentiment")
    status = labels.resolution(F.col("duplicate_of").isNotNull(), F.col("category"), F.col("severity"), F.col("sentiment"))
    return rows.select("id", status.alias("status"))


@query("h27_h28_agreement", over(CASES) + """
SELECT id, CASE WHEN category IS NULL THEN 'Unknown' WHEN category = 'Card' THEN 'High Confidence' ELSE 'Needs Review' END AS category_confidence,
  CASE WHEN sentiment IS NULL THEN 'Unknown' WHEN sentiment IN ('Angry', 'Frustrated') THEN 'High Confidence' ELSE 'Needs Review' END AS sentiment_confidence
FROM cases""")
def agreement_labels(spark, folder):
    rows = cases(spark, folder, "id", "category", "sentiment")
    return rows.select(
        "id",
        labels.category_agreement(F.col("category"), F.lit("Card")).alias("category_confidence"),
        labels.sentiment_agreement(F.col("sentiment"), labels.scorer_bucket(F.lit("LABEL_0"))).alias("sentiment_confidence"),
    )


@query("h30_intake_fallback", over(CASES) + """
SELECT id, customer_name, substr(COALESCE(text, ''), 1, 140) AS issue_summary, account_type, amount_involved, location AS location_mentioned,
  language AS detected_language, 0 AS keywords
FROM cases LEFT JOIN documents ON doc_id = id""")
def intake_fallback(spark, folder):
    rows = views.filed_texts(spark, folder)
    names = ("customer_name", "complaint_text", "account_type", "amount_involved", "location", "language")
    record = rows.select("id", text.intake_fallback({n: F.col(n) for n in names}).alias("r"))
    return record.select("id", "r.customer_name", "r.issue_summary", "r.account_type", "r.amount_involved",
                         "r.location_mentioned", "r.detected_language", F.size("r.urgency_keywords").alias("keywords"))


@query("h32_first_object", over(CASES) + """
SELECT id, '{"k": {"n": ' || id || ', "t": "' || CASE id % 3 WHEN 0 THEN 'a } b' WHEN 1 THEN 'a { b' ELSE 'say \\\"}\\\"' END || '"}}' AS json FROM cases""")
def first_object(spark, folder):
    """Nested objects, braces in strings and in prose, and a second object after the first."""
    rows = cases(spark, folder, "id")
    key = F.col("id")
    said = F.when(key % 3 == 0, "a } b").when(key % 3 == 1, "a { b").otherwise('say \\"}\\"')
    body = F.concat(F.lit('{"k": {"n": '), key.cast("string"), F.lit(', "t": "'), said, F.lit('"}}'))
    before = F.when(key % 4 == 0, "set {x} is \"given\": ").when(key % 4 == 1, "an open { here, ").otherwise("Here: ")
    after = F.when(key % 5 == 0, ' and {"second": 1}').when(key % 5 == 1, " with } and { after").otherwise(" Regards.")
    return rows.select("id", text.reply_object(F.concat(before, body, after)).alias("json"))


@query("h31_h32_intake_merge", over(CASES) + """
SELECT id, CASE WHEN id % 3 = 0 THEN 'From Reply' ELSE customer_name END AS customer_name,
  CASE WHEN id % 2 = 0 THEN 'loan' ELSE account_type END AS account_type, COALESCE(CAST(id AS DOUBLE), amount_involved) AS amount_involved,
  CASE WHEN id % 4 = 0 THEN 'urgent' ELSE 'urgent,blocked' END AS keywords FROM cases""")
def intake_merge(spark, folder):
    """Replies with code fences and prose around the JSON, as a model would send them."""
    rows = cases(spark, folder, "id", "customer_name", "account_type", "amount_involved", "language")
    key = F.col("id")
    body = F.concat(
        F.lit('{"customer_name": '), F.when(key % 3 == 0, '"From Reply"').otherwise("null"),
        F.lit(', "account_type": '), F.when(key % 2 == 0, '"loan"').otherwise('""'),
        F.lit(', "amount_involved": '), key.cast("string"),
        F.lit(', "urgency_keywords": '), F.when(key % 4 == 0, '"urgent"').otherwise('["urgent", "", "blocked"]'), F.lit("}"),
    )
    reply = F.when(key % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        key % 5 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Regards."))
    ).otherwise(body)
    staged = rows.withColumn("_reply", reply).withColumn("_json", text.reply_object(F.col("_reply")))
    staged = staged.withColumn("_record", text.intake_record(F.col("_json")))
    known = {n: F.col(n) for n in ("customer_name", "account_type", "amount_involved", "language")}
    merged = staged.select("id", text.intake_merged(F.col("_record"), known).alias("r"))
    return merged.select("id", "r.customer_name", "r.account_type", "r.amount_involved",
                         F.array_join("r.urgency_keywords", ",").alias("keywords"))


@query("h34_iso_instants", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events""")
def iso_instants(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    return events.select("event_id", labels.iso_instant(F.col("ts")).alias("at"))


# Unicode-aware boundaries for RE2: the character before a match is captured and put back.
_W, _NW = r"[\p{L}\p{M}\p{N}_]", r"[^\p{L}\p{M}\p{N}_]"
_STEPS = (
    ("EMAIL", rf"(^|{_NW})[A-Za-z0-9_][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b"),
    ("EMAIL", rf"({_W})[.%+\-][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b"),
    ("UPI", rf"(^|{_NW})[A-Za-z0-9_][A-Za-z0-9._\-]*[0-9.][A-Za-z0-9._\-]*@[a-z]{{2,}}\b"),
    ("PAN", rf"(^|{_NW})[A-Z]{{5}}[0-9]{{4}}[A-Z]\b"),
    ("IFSC", rf"(^|{_NW})[A-Z]{{4}}0[A-Z0-9]{{6}}\b"),
    ("CARD", rf"(^|{_NW})\d{{4}}[\s\-]?\d{{4}}[\s\-]?\d{{4}}[\s\-]?\d{{4}}\b"),
    ("AADHAAR", rf"(^|{_NW})\d{{4}}\s?\d{{4}}\s?\d{{4}}\b"),
    ("PHONE", rf"(^|{_NW})(?:91[\-\s]?)?[6-9]\d{{9}}\b"),
    ("ACCOUNT", rf"(^|{_NW})\d{{9,18}}\b"),
)


def _masked_sql(column: str) -> str:
    out = column
    for kind, pattern in _STEPS:
        out = f"regexp_replace({out}, '{pattern}', '\\1PII_{kind}', 'g')"
    return out


@query("p1_masked_text", f"SELECT doc_id, {_masked_sql('text')} AS masked FROM documents")
def masked_text(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", pii.masked_kinds(F.col("text")).alias("masked"))


_KINDS = list(pii.RULES)


@query("p5_identifier_counts", f"""
SELECT kind, SUM(n)::BIGINT AS identifiers FROM (
  SELECT unnest({_KINDS}) AS kind, unnest([{", ".join(f"len(regexp_extract_all(m, 'PII_{k}'))" for k in _KINDS)}]) AS n
  FROM (SELECT {_masked_sql('text')} AS m FROM documents)) GROUP BY 1""")
def identifier_counts(spark, folder):
    docs = table(spark, folder, "documents").select("text")
    names = [f"n_{k.lower()}" for k in _KINDS]
    totals = pii.identifier_counts(docs, "text").agg(*[F.sum(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(n).alias("identifiers")) for k, n in zip(_KINDS, names)])
    return totals.select(F.inline(pairs))


def _token_steps_sql() -> str:
    """Each masking step once more, with the values it takes out of the text that the steps before have left."""
    ctes, before = [], "SELECT doc_id, text AS t FROM documents"
    for i, (kind, pattern) in enumerate(_STEPS):
        cut = pattern.index(")") + 1
        grouped = f"{pattern[:cut]}({pattern[cut:]})"
        ctes.append(f"s{i} AS (SELECT doc_id, regexp_replace(t, '{pattern}', '\\1PII_{kind}', 'g') AS t, regexp_extract_all(t, '{grouped}', 2) AS v FROM ({before}))")
        before = f"SELECT doc_id, t FROM s{i}"
    kinds = dict.fromkeys(kind for kind, _ in _STEPS)
    parts = [
        "len(list_distinct(" + " || ".join(f"s{i}.v" for i, (k, _) in enumerate(_STEPS) if k == kind) + "))" for kind in kinds
    ]
    joins = " ".join(f"JOIN s{i} USING (doc_id)" for i in range(1, len(_STEPS)))
    return f"""WITH {", ".join(ctes)}
SELECT s0.doc_id, s{len(_STEPS) - 1}.t AS masked, CAST({" + ".join(parts)} AS INTEGER) AS tokens, 1 AS in_order FROM s0 {joins}"""


@query("p2_numbered_tokens", _token_steps_sql())
def numbered_tokens(spark, folder):
    """The text with its numbers taken out again (P1), the number of distinct identifiers, and whether each kind is numbered
    in the order of first appearance."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    masked = pii.mask_identifiers(docs, "text")
    kinds = "|".join(_KINDS)
    in_order = F.lit(True)
    for kind in _KINDS:
        numbers = F.array_distinct(F.regexp_extract_all("masked_text", F.lit(f"PII_{kind}_([0-9]+)"), F.lit(1)))
        in_order = in_order & (numbers == F.transform(numbers, lambda n, i: (i + 1).cast("string")))
    return masked.select(
        "doc_id", F.regexp_replace("masked_text", f"PII_({kinds})_[0-9]+", "PII_$1").alias("masked"),
        F.size("pii_tokens").alias("tokens"), in_order.cast("int").alias("in_order"),
    )


@query("p3_masked_names", r"""
SELECT doc_id, 'Dear PII_NAME_1, PII_NAME_1 wrote again. ' || CAST(doc_id AS VARCHAR) AS masked_text FROM documents""")
def masked_names(spark, folder):
    """A letter to a named person; the name is masked whole, in any case, before its parts."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("Person"), F.lower("source"), F.lit(" Sharma")).alias("name")
    )
    letters = docs.withColumn(
        "letter", F.concat(F.lit("Dear "), "name", F.lit(", "), F.upper("name"), F.lit(" wrote again. "), F.col("doc_id").cast("string"))
    )
    return pii.mask(letters, "letter", "name").select("doc_id", "masked_text")


@query("p4_round_trip", "SELECT doc_id, md5(text) AS digest FROM documents")
def round_trip(spark, folder):
    """Masking and unmasking returns every document unchanged."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    masked = pii.mask_identifiers(docs, "text")
    back = masked.select("doc_id", pii.unmask(F.col("masked_text"), F.col("pii_tokens")).alias("back"))
    return back.select("doc_id", F.md5("back").alias("digest"))


MAILS = """
mails AS (
  SELECT CAST(doc_id AS VARCHAR) AS mail_id, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE 'Person ' || CAST(doc_id AS VARCHAR) END AS from_name,
    CASE WHEN doc_id % 11 = 0 THEN 'No-Reply@' || source || '.example.com' WHEN doc_id % 13 = 0 THEN 'noreply@x.com'
      ELSE 'User' || CAST(doc_id AS VARCHAR) || '@' || source || '.example.com' END AS from_addr,
    CASE WHEN doc_id % 5 = 0 THEN substr(text, 3, 12) ELSE 'Case about Nagpur ' || CAST(doc_id AS VARCHAR) END AS subject,
    trim(CASE WHEN doc_id % 17 = 0 THEN 'Rs 1,' || CAST(doc_id % 900 + 100 AS VARCHAR) || '.50 lost. ' || text ELSE text END, E' \\n\\t\\r') AS body,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 700) AS sent_at
  FROM documents),
tagged AS (
  SELECT *, CASE WHEN subject <> '' AND NOT contains(lower(body), lower(subject)) THEN 'Subject: ' || subject || E'\\n\\n' || body ELSE body END AS t
  FROM mails),
judged AS (
  SELECT *, CASE WHEN contains(lower(from_addr), 'no-reply@') OR contains(lower(from_addr), 'noreply@') THEN 'blocked sender'
    WHEN trim(t, E' \\n\\t\\r') = '' THEN 'empty' END AS drop_reason FROM tagged)"""


@query("a4_mail_cases", over(MAILS) + rf"""
SELECT mail_id, CASE WHEN trim(from_name) = '' THEN split_part(from_addr, '@', 1) ELSE trim(from_name) END AS customer_name, 'email' AS channel,
  trim(t, E' \n\t\r') AS complaint_text, 'english' AS language, CAST(sent_at AS DATE) AS date, 'savings' AS account_type,
  COALESCE(
    TRY_CAST(replace(regexp_extract(t, '(?i)(?:Rs\.?|₹|INR)\s*([0-9,]+(?:\.[0-9]{{1,2}})?)', 1), ',', '') AS DOUBLE),
    TRY_CAST(replace(regexp_extract(t, '(?i)([0-9,]+(?:\.[0-9]{{1,2}})?)\s*(?:rupees?|/-)', 1), ',', '') AS DOUBLE)) AS amount_involved,
  {_city_sql("lower(subject || ' ' || t)")} AS location, from_addr AS customer_email
FROM judged WHERE drop_reason IS NULL""")
def mail_cases(spark, folder):
    return mail.normalise(views.mails(spark, folder), "2024-02-01")


@query("b12_mail_outcomes", over(MAILS) + "SELECT COALESCE(drop_reason, 'kept') AS outcome, COUNT(*) AS mails FROM judged GROUP BY 1")
def mail_outcomes(spark, folder):
    return mail.drop_counts(views.mails(spark, folder))


@query("f4_newest_mail", over(MAILS) + "SELECT mail_id, sent_at FROM mails ORDER BY sent_at DESC, mail_id DESC LIMIT 5")
def newest_mail(spark, folder):
    from casework.operators.queue import newest_mail as newest

    return newest(views.mails(spark, folder).select("mail_id", "sent_at"))


@query("a17_portal_cases", """
SELECT 'PORTAL-' || upper(sha256(email || chr(1) || customer_name || chr(1) || complaint_text || chr(1) || strftime(received_at, '%Y-%m-%d %H:%M:%S'))) AS id,
  account_no, email AS customer_email, customer_name, 'portal' AS channel, complaint_text, 'English' AS language,
  CAST(received_at AS DATE) AS date, location, CAST(NULL AS VARCHAR) AS account_type, amount AS amount_involved, 'open' AS status
FROM (SELECT 'c' || CAST(k AS VARCHAR) || '@example.org' AS email, 'Client ' || CAST(conv_id AS VARCHAR) AS customer_name, text AS complaint_text,
  CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END AS account_no, CASE WHEN k % 3 = 0 THEN 'Pune' END AS location,
  CASE WHEN k % 4 = 3 THEN CAST(k AS DOUBLE) END AS amount, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(k % 1000) AS received_at, k
  FROM (SELECT *, conv_id * 100 + turn AS k FROM conversations)) WHERE k % 5 <> 0 AND k % 7 <> 0 AND complaint_text <> ''""")
def portal_cases(spark, folder):
    return portal.shape_forms(views.portal_forms(spark, folder))


@query("a18_input_check", """
SELECT doc_id, CASE WHEN length(t) < 4 THEN 'too short' END AS reason, 'Walk-in' AS customer_name,
  'email' AS channel, lang AS language FROM (SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN 'abc' ELSE text END AS t FROM documents)""")
def input_check(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, "abc").otherwise(F.col("text")).alias("complaint_text"),
        F.col("lang").alias("language"),
    )
    return portal.check_input(rows).select("doc_id", "reason", "customer_name", "channel", "language")
