"""Masking cases, and the masker against a sequential statement of its rules over whole documents."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from casework.functions import pii

CASES = [
    ("My a/c 50100123456789 was debited, please call me on 9876543210", None, ("PII_ACCOUNT_1", "PII_PHONE_1"), ("50100123456789", "9876543210")),
    ("email rahul.k@gmail.com PAN ABCDE1234F aadhaar 1234 5678 9012 card 4111 1111 1111 1111 upi 9876501234@ybl", None, (),
     ("rahul.k@gmail.com", "ABCDE1234F", "1234 5678 9012", "4111 1111 1111 1111", "9876501234@ybl")),
    ("Hello, I am Rahul Sharma and Rahul is very upset about the UPI failure.", "Rahul Sharma", (), ("Rahul", "Sharma")),
    ("call 9876543210 or 9876543210 again", None, ("PII_PHONE_1",), ("9876543210",)),
    ("costs $5 \\ back to a.b@c.co, IFSC SBIN0001234 and +91 9876543210", "O'Neil (J.)", (), ("a.b@c.co", "SBIN0001234")),
    ("J. Neil+x wrote", "Neil+x Q", (), ("Neil+x",)),
]


@pytest.mark.parametrize("sample,name,present,absent", CASES)
def test_masks_and_round_trips(spark, sample, name, present, absent):
    df = spark.createDataFrame([(sample, name)], "t string, n string")
    row = pii.mask(df, "t", "n").withColumn("back", pii.unmask(F.col("masked_text"), F.col("pii_tokens"))).first()
    assert all(token in row["masked_text"] for token in present)
    assert not any(secret in row["masked_text"] for secret in absent)
    assert row["back"] == sample


def test_unchanged_and_empty(spark):
    rows = [("I lost 5000 rupees in a UPI txn dated 2026", None), ("The customer reported a card issue.", "Customer"),
            ("The customer came in.", "Walk-in"), ("", None), (None, None)]
    got = pii.mask(spark.createDataFrame(rows, "t string, n string"), "t", "n").collect()
    assert [r["masked_text"] for r in got] == [r[0] or "" for r in rows]


def test_tokens_survive_brackets_and_case(spark):
    df = spark.createDataFrame([("call [ pii_phone_1 ] or PII_PHONE_12, PII_PHONE_1",)], "t string")
    tokens = F.create_map(F.lit("PII_PHONE_1"), F.lit("99"), F.lit("PII_PHONE_12"), F.lit("77"))
    assert df.select(pii.unmask(F.col("t"), tokens)).first()[0] == "call 99 or 77, 99"


def test_name_numbering_is_longest_first(spark):
    row = pii.mask(spark.createDataFrame([("Asha met ASHA RAO and rao",  "Asha Rao")], "t string, n string"), "t", "n").first()
    assert row["masked_text"] == "PII_NAME_2 met PII_NAME_1 and PII_NAME_3"
    assert row["pii_tokens"] == {"PII_NAME_1": "Asha Rao", "PII_NAME_2": "Asha", "PII_NAME_3": "Rao"}


def test_name_equal_to_an_identifier_takes_no_number(spark):
    row = pii.mask(spark.createDataFrame([("from a1@b.co: Foo", "Foo a1@b.co")], "t string, n string"), "t", "n").first()
    assert row["masked_text"] == "from PII_EMAIL_1: PII_NAME_2"


def sequential(value: str) -> tuple[str, int]:
    seen: dict[str, str] = {}
    for kind, pattern in pii.RULES.items():
        order: list[str] = []

        def token(match, kind=kind, order=order):
            if match.group(0) not in seen:
                order.append(match.group(0))
                seen[match.group(0)] = f"PII_{kind}_{len(order)}"
            return seen[match.group(0)]

        value = re.sub(pattern, token, value)
    return value, len(seen)


def test_numbered_tokens_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pii.mask_identifiers(docs, "text").select("text", "masked_text", F.size("pii_tokens").alias("n")).collect()
    assert sum(r["n"] for r in got) > 20
    for row in got:
        assert (row["masked_text"], row["n"]) == sequential(row["text"])


def test_counts_follow_the_masked_text(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111 and 123456789012 and 9876543210 and 123456789",)], "t string")
    row = pii.identifier_counts(df, "t").first()
    assert (row["n_card"], row["n_aadhaar"], row["n_phone"], row["n_account"], row["n_email"]) == (1, 1, 1, 1, 0)
