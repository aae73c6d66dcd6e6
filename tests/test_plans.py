"""Enrichment and batch run invariants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from casework.models import breach, category, priority
from casework.operators import kpi
from casework.plans import enrich
from casework.queries.model_queries import text_cases
from casework.sources import views

FOLDER = "/root/testdata/sf0.001"
AS_OF = "2001-08-01"


def test_one_case_through_every_stage(spark):
    rows = [(1, "C", "twitter", "UPI down!! fraud", dt.date(2001, 7, 1), 100000.0, [1.0, 0.0]),
            (2, "C", "email", "Kindly help", dt.date(2001, 7, 2), None, [1.0, 0.0]),
            (3, "D", "email", "Kindly help", dt.date(2001, 7, 2), None, None)]
    df = spark.createDataFrame(
        rows, "id int, customer_name string, channel string, complaint_text string, date date, amount_involved double, embedding array<float>"
    )
    got = {r["id"]: r for r in enrich.enrich(df, AS_OF).collect()}
    first = got[1]
    assert (first["category"], first["severity"], first["sentiment"], first["status"]) == ("UPI", "Critical", "Angry", "open")
    assert (first["sla_due_date"], first["sla_breach_prob"]) == (dt.date(2001, 7, 3), 0.63)
    assert first["draft_response"].startswith("Dear C,") and "within 5 business days" in first["draft_response"]
    # ombudsman 25+30+6+12+2, churn 12+5+12+12+8, social 12+18+22+8
    assert (first["risk_ombudsman"], first["risk_churn"], first["risk_social"], first["risk_score"]) == (75, 49, 60, 63)
    assert (got[2]["duplicate_of"], got[2]["status"], got[2]["draft_response"], got[2]["similarity"]) == (1, "auto_resolved_dup", None, 1.0)
    assert (got[3]["duplicate_of"], got[3]["status"]) == (None, "auto_resolved_std")
    assert "complaint_text" not in first and "embedding" not in first


def test_pending_run_and_write_back(spark):
    rows = views.filed_texts(spark, FOLDER).join(views.cases(spark, FOLDER, "id", "processed_at"), "id")
    table = rows.withColumn("processed_at", F.col("processed_at").cast("timestamp_ntz"))
    done, alerts, summary = enrich.process_pending(table, AS_OF, threshold=0.3)
    numbers = summary.first()
    pending = table.where("processed_at is null").count()
    assert numbers["processed"] == pending and numbers["errors"] == 0 and numbers["alerts_detected"] == alerts.count()
    after = enrich.write_back(table, done)
    assert after.count() == table.count() and after.where("processed_at is null").count() == 0
    assert after.where("risk_score is not null").count() == pending


def test_unreadable_dates_are_kept_with_an_error(spark):
    df = spark.createDataFrame(
        [(1, "C", "text", None, None, None)],
        "id int, customer_name string, complaint_text string, date date, embedding array<float>, processed_at timestamp_ntz",
    )
    done, _, summary = enrich.process_pending(df, AS_OF, with_alerts=False)
    assert tuple(summary.first()) == (1, 1, 0) and done.first()["error"] == "unreadable filing date"


def test_scores_stay_in_range_and_ignore_row_order(spark):
    rows = views.filed_texts(spark, FOLDER)
    one = enrich.enrich(rows, AS_OF, 0.3)
    low, high = one.agg(F.min(F.least("risk_score", "priority_score")), F.max(F.greatest("risk_score", "priority_score"))).first()
    assert 0 <= low <= high <= 100
    two = enrich.enrich(rows.orderBy(F.desc("id")), AS_OF, 0.3, block_rows=10)
    wanted = ["id", "category", "duplicate_of", "similarity", "risk_score", "priority_score", "status"]
    assert {tuple(r) for r in one.select(*wanted).collect()} == {tuple(r) for r in two.select(*wanted).collect()}


def test_rows_broken_in_four_ways_come_through_with_their_errors(spark):
    nan = float("nan")
    rows = [
        (1, "C", "text", "2001-07-01", "5", [1.0, 0.0]), (2, "C", "text", "01/02", "x", [1.0, 0.0]), (3, "C", "text", "2001-07-01", "NaN", [nan, 0.0]),
        (4, "C", "text", "2001-07-01", None, [None, 1.0]), (5, None, None, None, "1", [1.0]), (6, "C", "text", "2001-07-01", None, None),
    ]
    df = spark.createDataFrame(rows, "id int, customer_name string, complaint_text string, date string, amount_involved string, embedding array<float>")
    df = df.withColumn("location", F.lit("Pune"))
    df = df.withColumn("processed_at", F.lit(None).cast("timestamp_ntz"))
    done, alerts, summary = enrich.process_pending(df, AS_OF, threshold=0.3)
    got = {r["id"]: sorted(e["column"] for e in r["errors"]) for r in done.collect()}
    assert got == {1: [], 2: ["amount_involved", "date"], 3: ["amount_involved", "embedding"], 4: ["embedding"], 5: ["date", "embedding"], 6: []}
    assert summary.first()["errors"] == 4 and alerts.count() == 0
    assert {r["id"]: r["duplicate_of"] for r in done.where("duplicate_of is not null").collect()} in ({2: 1}, {1: 2})
    kinds = {r["column"]: r["cases"] for r in kpi.error_summary(done).collect()}
    assert kinds == {"date": 2, "amount_involved": 2, "embedding": 3}
    assert enrich.checked(df.select("id")).first()["errors"] == [] and enrich.checked(df.limit(0)).count() == 0


def test_known_cases_are_candidates_and_history(spark):
    schema = "id int, customer_name string, channel string, complaint_text string, date date, amount_involved double, embedding array<float>"
    old = spark.createDataFrame([(1, "C", "email", "atm", dt.date(2001, 7, 20), None, [1.0, 0.0]),
                                 (9, "Z", "email", "atm", dt.date(2001, 7, 20), None, [1.0, 0.0])], schema)
    new = spark.createDataFrame([(2, "C", "email", "loan", dt.date(2001, 7, 1), None, [1.0, 0.0]),
                                 (3, None, "email", "loan", dt.date(2001, 7, 1), None, None)], schema)
    stored = enrich.enrich(old, AS_OF).join(old.select("id", "embedding"), "id")
    got = {r["id"]: r for r in enrich.enrich(new, AS_OF, known=stored).collect()}
    assert set(got) == {2, 3}
    # The stored case was filed later but indexed first. History: two cases, one open, two categories.
    assert (got[2]["duplicate_of"], got[2]["risk_churn"]) == (1, 12 + 5 + 12)
    assert got[3]["risk_churn"] == 6 + 5 + 6


def test_fitted_models_score_their_stages(spark):
    cases = text_cases(spark, FOLDER)
    texts = views.texts(spark, FOLDER).select("id", "complaint_text")
    models = {
        "breach": breach.train(cases, AS_OF, {"GradientBoosting": 2}, stacking=False, folds=2),
        "category": category.fit(category.training_rows(texts, texts, "weak"), "weak labels"),
        "sentiment": category.sentiment_scorer_by_rule,
        "priority": priority.train(cases, AS_OF, rounds=2),
    }
    rows = views.filed_texts(spark, FOLDER)
    wanted = ["id", "category", "severity", "amount_involved", "duplicate_of", "sla_breach_prob", "priority_score", "ml_category", "ml_category_prob",
              "category_confidence", "ml_sentiment", "sentiment_confidence"]
    by_rule = {r["id"]: r for r in enrich.enrich(rows, AS_OF, 0.3).select(*wanted).collect()}
    scored = enrich.enrich(rows, AS_OF, 0.3, **models)
    by_model = {r["id"]: r for r in scored.select(*wanted).collect()}
    assert by_rule.keys() == by_model.keys() and len(by_rule) == rows.count()
    for key, r in by_model.items():
        rule = by_rule[key]
        assert [r[c] for c in ("category", "severity", "amount_involved", "duplicate_of")] == [rule[c] for c in ("category", "severity", "amount_involved", "duplicate_of")]
        assert 0 <= r["sla_breach_prob"] <= 1 and 0 <= r["priority_score"] <= 100 and 0 < r["ml_category_prob"] <= 1
        assert r["ml_category"] in models["category"].classes and r["category_confidence"] != "Unknown" and r["sentiment_confidence"] == "High Confidence"
        assert rule["ml_category"] is None and rule["category_confidence"] == "Unknown" and rule["ml_sentiment"] is None
    assert {r["sla_breach_prob"] for r in by_model.values()} != {r["sla_breach_prob"] for r in by_rule.values()}
    table = rows.select("id").withColumns({"processed_at": F.lit(None).cast("timestamp_ntz"), "ml_category": F.lit(None).cast("string")})
    assert enrich.write_back(table, scored).where("ml_category is null or category_confidence is null").count() == 0


def test_a_pending_run_stores_pending_cases_once_and_no_text_with_the_clusters(spark, monkeypatch):
    from casework.operators import rootcause

    enriched, stored, whole, kept = [], [], enrich.enrich, rootcause.cut_lineage
    monkeypatch.setattr(enrich, "enrich", lambda cases, *a, **o: enriched.append(cases) or whole(cases, *a, **o))
    monkeypatch.setattr(rootcause, "cut_lineage", lambda df: stored.append(df.columns) or kept(df))
    words = [f"case {i} about a card" for i in range(12)]
    rows = [(i, f"C{i % 2}", words[i], dt.date(2001, 7, 1), None if i == 5 else [float(i % 2), 1.0] if i else [1.0], "Pune", dt.datetime(2001, 7, 2) if i % 3 else None)
            for i in range(12)]
    df = spark.createDataFrame(
        rows, "id int, customer_name string, complaint_text string, date date, embedding array<float>, location string, processed_at timestamp_ntz"
    )
    done, alerts, summary = enrich.process_pending(df, AS_OF)
    assert sorted(stored[0]) == ["category", "embedding", "features", "location"]
    assert len(enriched[0].inputFiles()) > 0 and sorted(r["id"] for r in enriched[0].collect()) == [0, 3, 6, 9]
    assert summary.first()["processed"] == 4 and [r["id"] for r in done.where("error is not null").collect()] == [0]
    assert alerts.count() == summary.first()["alerts_detected"]
