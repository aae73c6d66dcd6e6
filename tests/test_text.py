"""Hand-computed text rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casework.functions import text

RULES = [
    ("UPI payment failed, amount debited", 2000.0, "UPI", "High", "Neutral"),
    ("Kindly update my home loan statement", None, "Loan", "Low", "Polite"),
    ("Worst bank!! ATM swallowed my card", 60000.0, "ATM", "Critical", "Angry"),
    ("When will internet banking work?", 10.0, "NetBanking", "Medium", "Frustrated"),
    ("Branch was closed", None, "General", "Low", "Neutral"),
    ("Seat was occupied", None, "UPI", "Low", "Neutral"),
    ("Premium account query", None, "Loan", "Low", "Neutral"),
    ("कृपया मेरा खाता देखें", 0.0, "General", "Low", "Polite"),
    (None, None, "General", "Low", "Neutral"),
    ("blocKed loan", None, "Loan", "Low", "Neutral"),
    ("pleaſe help, my ınternet bankıng", None, "NetBanking", "Low", "Polite"),
    ("CASH lost in the\nmachine", None, "General", "Low", "Neutral"),
    ("cash stuck in machine", None, "ATM", "High", "Neutral"),
]


def test_keyword_rules(spark):
    df, scanned = text.scan(spark.createDataFrame([(t, a) for t, a, *_ in RULES], "t string, a double"), "t")
    got = df.select(
        text.keyword_category(scanned), text.severity_rule(scanned, F.col("a")), text.sentiment_rule(scanned)
    ).collect()
    assert [tuple(r) for r in got] == [tuple(r[2:]) for r in RULES]


@pytest.mark.parametrize(
    "sample,weak,plain",
    [
        ("paid by PhonePe", "UPI", "General"),
        ("occupied seat", "General", "UPI"),
        ("कार्ड बंद", "Card", "General"),
        ("ऋण चाहिए", "Loan", "General"),
        ("the mobile app fails", "NetBanking", "General"),
        ("netbanking is down", "NetBanking", "NetBanking"),
        ("postcards", "General", "Card"),
    ],
)
def test_weak_and_substring_categories(spark, sample, weak, plain):
    df, scanned = text.scan(spark.createDataFrame([(sample,)], "t string"), "t")
    row = df.select(text.weak_category(scanned), text.substring_category(scanned.lowered)).first()
    assert tuple(row) == (weak, plain)


def test_amounts(spark):
    samples = {
        "Rs 5,000 lost": 5000.0,
        "₹1,234.50": 1234.5,
        "INR 99": 99.0,
        "lost 700 rupees": 700.0,
        "pay 450/-": 450.0,
        "no money": None,
        "Rs , then 70 rupees": 70.0,
        "rs.12.345": 12.34,
        None: None,
    }
    df, scanned = text.scan(spark.createDataFrame([(t,) for t in samples], "t string"), "t")
    got = [r[0] for r in df.select(text.amount_from_text(scanned)).collect()]
    assert got == list(samples.values())


def test_language_modes(spark):
    rows = [("plain", "english", "english"), ("पैसे कट गए", "english", "hindi"), ("समस्या आहे", "marathi", "marathi"),
            ("नहीँ", "hindi", "hindi")]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select("t", text.language_tag(F.col("t")), text.language_tag(F.col("t"), "script")).collect()
    assert [tuple(r) for r in got] == rows
    with pytest.raises(ValueError):
        text.language_tag(F.col("t"), "other")


def test_first_listed_city_wins(spark):
    df = spark.createDataFrame([("from agra to mumbai",), ("nowhere",)], "t string")
    assert [r[0] for r in df.select(text.city_tag(F.col("t"))).collect()] == ["Mumbai", None]


def test_canonical_labels(spark):
    samples = {"card": "Card", "Credit Card": "Card", "  UPI ": "UPI", "": "General", None: "General", "other": "General"}
    df = spark.createDataFrame([(t,) for t in samples], "t string")
    got = [r[0] for r in df.select(text.canonical_label(F.col("t"), ("UPI", "ATM", "Card"), "General")).collect()]
    assert got == list(samples.values())


def test_lengths_words_and_fraud(spark):
    df = spark.createDataFrame([("  two words \n",), ("",), (None,), ("HACKED now",)], "t string")
    got = df.select(text.text_length(F.col("t")), text.word_count(F.col("t")), text.fraud_flag(F.lower(F.coalesce("t", F.lit(""))))).collect()
    assert [tuple(r) for r in got] == [(13, 2, 0), (0, 0, 0), (0, 0, 0), (10, 2, 1)]


def test_replies_become_records(spark):
    replies = [
        '{"customer_name": "A", "urgency_keywords": ["x", ""], "amount_involved": 5}',
        '```json\n{"customer_name": "", "urgency_keywords": "now"}\n```',
        'Sure: {"account_type": "loan"} done',
        "no object",
        None,
    ]
    df = spark.createDataFrame([(r,) for r in replies], "reply string").withColumn("json", text.reply_object(F.col("reply")))
    df = df.withColumn("r", text.intake_record(F.col("json")))
    known = {
        "customer_name": F.lit("Known"), "account_type": F.lit("savings"), "amount_involved": F.lit(9.0), "language": F.lit("hindi"),
    }
    got = df.select(text.intake_merged(F.col("r"), known).alias("m")).select("m.*").collect()
    assert [r["customer_name"] for r in got] == ["A", "Known", "Known", "Known", "Known"]
    assert [r["account_type"] for r in got][:3] == ["savings", "savings", "loan"]
    assert [r["amount_involved"] for r in got][:3] == [5.0, 9.0, 9.0]
    assert [r["urgency_keywords"] for r in got][:3] == [["x"], ["now"], []]
    assert got[0]["detected_language"] == "hindi"


def test_first_balanced_object(spark):
    said = {
        'x {"a": 1} y {"b": 2} z': '{"a": 1}', 'see {this} first: {"a": {"b": "}"}} and }': '{"a": {"b": "}"}}',
        'open { quote {"a": "\\"{"}': '{"a": "\\"{"}', '{"a": 1': None, '} {': None, "": None, 'it"s {"a": "{"} ok': '{"a": "{"}',
    }
    df = spark.createDataFrame([(k,) for k in said], "reply string")
    assert {r.reply: r.json for r in df.select("reply", text.reply_object(F.col("reply")).alias("json")).collect()} == said


def test_intake_fallback(spark):
    df = spark.createDataFrame(
        [("N", "t" * 200, "loan", 5.0, "Pune", None)],
        "customer_name string, complaint_text string, account_type string, amount_involved double, location string, language string",
    )
    row = df.select(text.intake_fallback({c: F.col(c) for c in df.columns}).alias("r")).select("r.*").first()
    assert len(row["issue_summary"]) == 140
    assert (row["location_mentioned"], row["detected_language"], row["urgency_keywords"]) == ("Pune", "english", [])
