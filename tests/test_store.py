"""Skew-safe joins and table maintenance."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework import schemas
from casework.operators import feedback, history, kpi, metrics, queue, store, strikes
from casework.operators.skew import attach_by_key
from casework.sources import dims, files, mail, portal


@pytest.mark.parametrize("hot_keys", [0, 1, 1000])
def test_attach_by_key_is_a_left_join_for_any_hot_set(spark, hot_keys):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, (F.col("id") % 50).cast("string")).alias("k")
    )
    per_key = rows.groupBy("k").agg(F.count("*").alias("w")).where("k is null or k <> '11'").withColumn("twice", F.col("w") * 2)
    got = {tuple(r) for r in attach_by_key(rows, per_key, "k", "w", "id", hot_keys).collect()}
    want = {
        tuple(r) for r in rows.join(per_key.where("k is not null"), "k", "left").select("id", "k", "twice").collect()
    }
    assert got == want and len(got) == 3000


def test_hot_customer_gets_the_same_history(spark):
    rows = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 != 1, "Walk-in").otherwise((F.col("id") % 40).cast("string")).alias("customer_name")
    )
    got = history.complaint_counts(rows).groupBy("customer_name").agg(
        F.count("*").alias("n"), F.min("customer_complaint_count").alias("lo"), F.max("customer_complaint_count").alias("hi")
    ).collect()
    assert all(r["n"] == r["lo"] == r["hi"] for r in got)
    assert {r["customer_name"]: r["n"] for r in got}["Walk-in"] == 1333


def test_insert_if_absent_is_idempotent(spark):
    old = spark.createDataFrame([(1, "2026-01-01", "UPI")], "id int, date string, category string")
    new = spark.createDataFrame([(1, "2026-02-01"), (2, "2026-02-02"), (2, "2026-02-01"), (None, "2026-02-01")], "id int, date string")
    once = store.insert_if_absent(old, new)
    twice = store.insert_if_absent(once, new)
    want = [(1, "2026-01-01", "UPI"), (2, "2026-02-01", None)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_patch_writes_nulls_and_rejects_unknown_columns(spark):
    base = spark.createDataFrame([(1, "open", 5), (2, "open", 6)], "id int, status string, priority_score int")
    patches = spark.createDataFrame([(1, None, 9, False)], "id int, status string, priority_score int, priority_score_set boolean")
    assert sorted(map(tuple, store.patch(base, patches).collect())) == [(1, None, 5), (2, "open", 6)]
    with pytest.raises(ValueError, match="customer_name"):
        store.patch(base, spark.createDataFrame([(1, "x")], "id int, customer_name string"))


def test_audit_trail_has_changed_rows_only(spark):
    before = spark.createDataFrame([(1, "open"), (2, None), (3, "open")], "id int, status string")
    after = spark.createDataFrame([(1, "resolved"), (2, None), (3, "open")], "id int, status string")
    rows = store.audit_trail(before, after, "id", ["status"], "me").collect()
    assert [(r["complaint_id"], json.loads(r["before_state"]), json.loads(r["after_state"])) for r in rows] == [
        (1, {"status": "open"}, {"status": "resolved"})
    ]


def test_ids_are_consecutive_even_for_one_hot_day(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("2026-01-02")).otherwise(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 9).cast("int"))).cast("date").alias("date")
    )
    got = store.allocate_ids(rows, 9_990, "id", "2026-01-03").select("new_id", "date").collect()
    numbers = sorted(int(r["new_id"].removeprefix("UBI-")) for r in got)
    assert numbers == list(range(9_991, 14_991))
    by_number = sorted(got, key=lambda r: int(r["new_id"][4:]))
    assert [r["date"] for r in by_number] == sorted(r["date"] for r in got)


def test_ids_start_after_the_highest_suffix(spark):
    stored = spark.createDataFrame([("UBI-0007",), ("PORTAL-AB",), ("UBI-0003",)], "id string")
    new = spark.createDataFrame([("x", None)], "raw string, date date")
    row = store.allocate_ids(new, store.last_number(stored), "raw", "2026-01-01").first()
    assert (row["new_id"], row["date"]) == ("UBI-0008", dt.date(2026, 1, 1))


def test_dangling_references_count_their_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 9), (4, 9)], "id int, duplicate_of int")
    got = store.dangling_references(rows, "duplicate_of", rows, "id", "self").collect()
    assert [tuple(r) for r in got] == [("self", "9", 2)]


def test_outbox_address_order(spark):
    cases = spark.createDataFrame(
        [(1, "a@b.c", "portal", "7", "text"), (2, None, "portal", "7", "text"), (3, "", "email", "7", "text"),
         (4, None, "portal", "8", "text"), (5, "a@b.c", "email", "7", None)],
        "id int, customer_email string, channel string, account_no string, draft_response string",
    )
    users = spark.createDataFrame([("7", "user@x.y"), ("8", "")], "account_no string, email string")
    got = {r["id"]: r["to_email"] for r in store.outbox(cases, users).collect()}
    assert got == {1: "a@b.c", 2: "user@x.y"}


def test_last_correction_wins_and_applies(spark):
    reviews = spark.createDataFrame(
        [(1, 10, "category", "UPI", False, "2026-01-01 00:00:00"), (2, 10, "category", "Card", False, "2026-01-01 00:00:00"),
         (3, 10, "severity", None, False, "2026-01-02 00:00:00"), (4, 10, "id", "x", False, "2026-01-02 00:00:00"),
         (5, 11, "category", "Loan", True, "2026-01-02 00:00:00")],
        "id int, complaint_id int, field string, corrected_value string, is_correct boolean, created_at string",
    )
    cases = spark.createDataFrame([(10, "ATM", "Low"), (11, "ATM", "Low")], "id int, category string, severity string")
    got = feedback.apply_corrections(cases, reviews, ("category", "severity")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(10, "Card", "Low"), (11, "ATM", "Low")]
    assert feedback.stats(reviews.limit(0)).first()["accuracy_rate"] is None
    assert tuple(feedback.stats(reviews).first()) == (5, 1, 4, 0.2)


def test_conform_adds_and_casts(spark):
    raw = spark.createDataFrame([("1", "2026-05-01T23:59:00.000Z", "12.5"), ("2", "soon", "much")], "id string, date string, amount_involved string")
    got = schemas.conform(raw, schemas.CASE)
    assert got.schema.names == schemas.CASE.names
    assert [(r["date"], r["amount_involved"], r["embedding"]) for r in got.orderBy("id").collect()] == [
        (dt.date(2026, 5, 1), 12.5, None), (None, None, None)
    ]


def test_queue_views(spark):
    cases = spark.createDataFrame(
        [(1, "High", "UPI", "email", 0.5, 10), (2, "Low", "UPI", "email", None, None), (3, "High", "Card", "branch", 0.9, 90)],
        "id int, severity string, category string, channel string, sla_breach_prob double, priority_score int",
    )
    assert [r["id"] for r in queue.queue(cases).collect()] == [3, 1, 2]
    assert [r["id"] for r in queue.queue(cases, high_risk_only=True, channels=["email"]).collect()] == [1]
    shown = queue.display(cases).columns
    assert shown == ["Complaint ID", "Channel", "Category", "Severity", "Priority", "Breach probability"]
    with pytest.raises(ValueError):
        queue.search(cases, limit=501)


def test_empty_aggregates(spark):
    empty = spark.createDataFrame([], "status string, processed_at date, sla_breach_prob double, sla_due_date date")
    assert tuple(kpi.kpi_strip(empty).first()) == (0, 0, 0, 0, 0.0)
    assert [r["cases"] for r in kpi.sla_histogram(empty, "2026-01-01").collect()] == [0] * 5


def test_severity_order_and_unknown_values(spark):
    rows = spark.createDataFrame([("Low",), ("Odd",), (None,), ("Critical",)], "severity string")
    assert [r["severity"] for r in kpi.by_severity(rows).collect()] == ["Critical", "Low", "Odd"]


@pytest.mark.parametrize("age_days,count,blocked", [(0, 15, True), (0, 14, False), (2, 15, True), (3, 15, False)])
def test_block_rule(spark, age_days, count, blocked):
    start = dt.datetime(2026, 5, 29, 0, 0) - dt.timedelta(days=age_days)
    rows = [(i, "A", start + dt.timedelta(minutes=i)) for i in range(count)]
    df = spark.createDataFrame(rows, "id int, account_number string, created_at timestamp_ntz")
    assert (strikes.blocked_accounts(df, "2026-05-29 12:00:00").count() == 1) is blocked


def test_later_strikes_hide_no_blocking_day(spark):
    old = [(i, "A", dt.datetime(2026, 5, 28, 0, i)) for i in range(15)]
    new = [(100 + i, "A", dt.datetime(2026, 5, 29, 0, i)) for i in range(6)]
    df = spark.createDataFrame(old + new, "id int, account_number string, created_at timestamp_ntz")
    assert [r["strikes_on_worst_day"] for r in strikes.blocked_accounts(df, "2026-05-29 12:00:00").collect()] == [15]
    spread = [(i, "A", dt.datetime(2026, 5, 28 + i % 2, 1, i)) for i in range(15)]
    df = spark.createDataFrame(spread, "id int, account_number string, created_at timestamp_ntz")
    assert strikes.blocked_accounts(df, "2026-05-29 12:00:00").count() == 0


def test_csv_report_has_mark_and_header_in_every_part(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("Complaint ID"), F.lit(None).cast("string").alias("Type")).repartition(3)
    path = files.write_report_csv(df, str(tmp_path), "2026-05-29")
    parts = sorted((tmp_path / "report_date=2026-05-29").glob("*.csv"))
    assert path.endswith("report_date=2026-05-29") and len(parts) == 3
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfComplaint ID,Type\n") for p in parts)


def test_json_report_turns_nan_into_null(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"))], "id int, p double")
    path = files.write_report_json(df, df.select("id"), str(tmp_path), "2026-05-29")
    rows = [json.loads(line) for p in (tmp_path / "report_date=2026-05-29" / "rows").glob("*.json") for line in p.read_text().splitlines()]
    assert rows == [{"id": 1, "p": None}] and path


def test_seed_json_and_case_table(spark, tmp_path):
    seed = tmp_path / "seed.json"
    seed.write_text(json.dumps([{"id": "UBI-0001", "date": "2026-05-01", "amount_involved": 5, "extra": 1}]))
    cases = schemas.conform(files.read_seed_json(spark, str(seed)), schemas.CASE)
    files.write_cases(cases, str(tmp_path / "table"))
    back = spark.read.parquet(str(tmp_path / "table"))
    assert back.first()["id"] == "UBI-0001" and str(back.first()["filed_month"]) == "2026-05"


def test_alert_table_is_replaced(spark, tmp_path):
    path = str(tmp_path / "alerts")
    store.replace_alerts(spark.createDataFrame([(1, "a")], "id int, summary string"), path)
    store.replace_alerts(spark.range(30).select(F.col("id"), F.lit("b").alias("summary")), path)
    assert [r["id"] for r in store.latest_alerts(spark.read.parquet(path)).collect()] == list(range(29, 9, -1))


def test_dimensions(spark):
    cities = dims.city_coordinates(spark)
    assert cities.count() == 62 and cities.where("location = 'Pune'").first()["lat"] == 18.5204
    assert dims.sla_rules(spark).count() == 24


def test_mail_rules(spark):
    rows = [
        ("1", " Asha ", "asha@x.y", "Help", "Rs 50 lost in Pune", None),
        ("2", "", "jo.doe@x.y", "lost", "card LOST today", None),
        ("3", "Bot", "No-Reply@x.y", "s", "b", None),
        ("4", "E", "e@x.y", "", "  ", None),
        ("5", "F", "f@x.y", "S", "z" * 5000, None),
    ]
    df = spark.createDataFrame(rows, schemas.MAIL)
    got = {r["mail_id"]: r for r in mail.normalise(df, "2026-05-29").collect()}
    assert set(got) == {"1", "2", "5"}
    assert got["1"]["complaint_text"] == "Subject: Help\n\nRs 50 lost in Pune"
    assert (got["1"]["customer_name"], got["1"]["amount_involved"], got["1"]["location"]) == ("Asha", 50.0, "Pune")
    assert (got["2"]["customer_name"], got["2"]["complaint_text"]) == ("jo.doe", "card LOST today")
    assert len(got["5"]["complaint_text"]) == 5012 and got["5"]["date"] == dt.date(2026, 5, 29)


def test_portal_amounts_and_validity(spark):
    samples = {"12": 12.0, "12.5abc": 12.5, "abc": None, "": None, "0": None, "NaN": None, "-3": -3.0, None: None}
    df = spark.createDataFrame([(s,) for s in samples], "a string")
    assert [r[0] for r in df.select(portal.portal_amount(F.col("a"))).collect()] == list(samples.values())
    rows = spark.createDataFrame([("1", True, "t"), ("2", False, "t"), ("3", None, "t")], "account_no string, is_valid boolean, created_at string")
    kept, struck = portal.split_valid(rows)
    assert [r["account_no"] for r in kept.collect()] == ["1", "3"]
    assert [r["account_number"] for r in struck.collect()] == ["2"]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "a double, p double")
    assert tuple(metrics.regression(df, "a", "p").first()) == (0.333, 0.5)
    labels = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y")], "a string, p string")
    rows = {r["class"]: tuple(r)[1:] for r in metrics.class_report(labels, "a", "p", ["x", "y", "z"]).collect()}
    assert rows == {"x": (1.0, 0.5, 0.6667, 2), "y": (0.5, 1.0, 0.6667, 1), "z": (0.0, 0.0, 0.0, 0)}


def test_drift_is_zero_for_equal_shares_and_silent_for_few_rows(spark):
    rows = spark.range(400).select((F.col("id") % 4).cast("string").alias("c"))
    same = metrics.drift(rows, rows, {"c": F.col("c")}).first()
    assert (same["psi"], same["drifted"]) == (0.0, False)
    moved = metrics.drift(rows, rows.where("c <> '0'"), {"c": F.col("c")}).first()
    assert moved["drifted"]
    assert [r.too_small for r in metrics.drift(rows, rows.limit(10), {"c": F.col("c")}).collect()] == [True]


def test_numeric_drift_over_quantile_sketches(spark):
    rng = np.random.default_rng(3)
    old, new = rng.lognormal(8, 1, 20_000), rng.lognormal(8.5, 1, 15_000)
    frame = lambda xs: spark.createDataFrame([(float(x), float(x) % 7, None) for x in xs] + [(None, float("nan"), None)] * 10, "a double, b double, e double")
    before, now = frame(old), frame(new)
    edges = metrics.quantile_edges(metrics.quantile_sketches(before, ["a", "b", "e"]), ["a", "b", "e"])
    assert len(edges["a"]) == 9 and edges["e"] == []
    assert all(abs((old <= e).mean() - (i + 1) / 10) < 0.005 for i, e in enumerate(edges["a"]))
    parts = metrics.quantile_sketches(before.where("a < 3000"), ["a"]).unionByName(metrics.quantile_sketches(before.where("a >= 3000"), ["a"]))
    merged = metrics.quantile_edges(metrics.merged_sketches(parts, ["a"]), ["a"])["a"]
    assert all(abs((old <= e).mean() - (i + 1) / 10) < 0.01 for i, e in enumerate(merged))
    got = {r["column"]: r for r in metrics.numeric_drift(before, now, ["a", "b", "e"]).collect()}
    gap = max(abs((old <= e).mean() - (new <= e).mean()) for e in edges["a"])
    assert got["a"]["drifted"] and abs(got["a"]["distance"] - gap) < 0.01
    assert not got["b"]["drifted"] and got["b"]["distance"] < 0.03
    assert (got["e"]["psi"], got["e"]["distance"]) == (0.0, None)
    assert metrics.numeric_drift(before, now.limit(0), ["a"]).first()["distance"] is None
