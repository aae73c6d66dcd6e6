"""Small training runs: shapes, invariants and quality that must hold on separable data."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from casework.models import breach, category, ensembles, features, priority, smote, split
from casework.models.backfill import backfill
from casework.queries.model_queries import text_cases

FOLDER = "/root/testdata/sf0.001"
AS_OF = "2001-08-01"
SMALL = {"RandomForest": 4, "GradientBoosting": 3}


@pytest.fixture(scope="module")
def cases(spark):
    return text_cases(spark, FOLDER).persist()


@pytest.fixture(scope="module")
def prepared(cases):
    table = breach.training_table(cases, AS_OF)
    encoder = breach.encoded(table)
    return table, encoder, encoder.transform(table).select("id", "label", "weight", "fold", "features").persist()


def test_labels_of_each_kind(spark):
    rows = [
        ("open", "Medium", 10, None, 9, 1), ("open", "Medium", 10, None, 10, 0), ("open", "Critical", 9, None, 10, 1),
        ("open", "Critical", 8, None, 10, 0), ("escalated", "Low", 11, None, 10, 1), ("resolved", "Low", 90, 11, 10, 1),
        ("resolved", "Low", 90, 10, 10, 0), ("auto_resolved_dup", "Critical", 90, None, 10, 0), (None, "Low", 11, None, 10, 1),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "status string, severity string, age int, closed int, days_to_sla int")
    df = df.withColumn("date", F.date_sub(F.lit(AS_OF).cast("date"), F.col("age")))
    df = df.withColumn("resolved_at", F.date_add("date", F.col("closed")))
    assert [r[0] for r in df.select(features.breach_label(AS_OF)).collect()] == [r[5] for r in rows]


def test_features_are_complete_and_defaulted(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, None, None, None, None, None, None, "UPI stuck twice", None)],
        "id int, customer_name string, channel string, language string, account_type string, category string, severity string, "
        "sentiment string, amount_involved double, date date, complaint_text string, duplicate_of string",
    )
    row = features.sla_features(df, AS_OF).first()
    assert [row[c] for c in features.CATEGORICAL] == ["email", "english", "savings", "UPI", "Medium", "Neutral"]
    assert (row["complaint_word_count"], row["is_fraud_keyword"], row["customer_complaint_count"], row["days_to_sla"]) == (3, 1, 1, 5)
    assert (row["hours_since_filed"], row["day_of_week"], row["pct_sla_elapsed"], row["is_repeat_customer"]) == (0.0, 0, 0.0, 0)


def test_splits_do_not_depend_on_partitioning(spark):
    rows = spark.range(2000).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    train, test = split.holdout(rows)
    again, _ = split.holdout(rows.repartition(13))
    assert {r["id"] for r in train.collect()} == {r["id"] for r in again.collect()}
    share = test.count() / 2000
    positives = test.agg(F.avg("label")).first()[0]
    assert 0.17 < share < 0.23 and 0.15 < positives < 0.25
    folds = [r["count"] for r in split.with_folds(rows).groupBy("fold").count().collect()]
    assert len(folds) == 5 and min(folds) > 300


def test_classes_are_split_evenly(spark):
    rows = spark.range(1000).withColumn("label", F.when(F.col("id") < 13, 1.0).otherwise(0.0))
    train, test = split.holdout(rows, label="label")
    assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {0.0: 197, 1.0: 2}
    assert train.count() + test.count() == 1000 and train.join(test, "id").count() == 0
    sizes = split.with_folds(rows, label="label").groupBy("label", "fold").count().collect()
    assert {r["fold"] for r in sizes if r["label"] == 1.0} == set(range(5)) and all(r["count"] in (2, 3, 197, 198) for r in sizes)
    few = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 1.0)], "id int, label double")
    train, test = split.holdout(few, label="label")
    assert (train.count(), [r["label"] for r in test.collect()]) == (2, [0.0])
    assert split.bounded(rows, 100).count() == 100


def test_balanced_weights_sum_to_the_rows(spark):
    rows = spark.range(100).withColumn("label", (F.col("id") < 20).cast("int"))
    sums = {r["label"]: r["s"] for r in split.with_balance(rows).groupBy("label").agg(F.sum("weight").alias("s")).collect()}
    assert sums == pytest.approx({0: 50.0, 1: 50.0})


@pytest.mark.parametrize("block_rows", [4, 8192])
def test_oversampling_interpolates_between_near_neighbours(spark, block_rows):
    rows = [(i, 1.0, [float(i), 0.0]) for i in range(10)] + [(100 + i, 0.0, [50.0, 50.0]) for i in range(45)]
    df = spark.createDataFrame(rows, "id bigint, label double, p array<double>").withColumn("features", array_to_vector("p"))
    out = smote.oversample(df, block_rows=block_rows)
    sizes = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert sizes == {0: 45, 1: 45}
    for row in out.where("label = 1").collect():
        x, y = row["features"].toArray()
        assert y == 0.0 and 0.0 <= x <= 9.0


def test_candidates_learn_and_leaderboard_is_ordered(spark, cases):
    trained = breach.train(cases, AS_OF, SMALL, stacking=False, folds=2)
    board = trained.leaderboard
    assert [r["cv_auc_mean"] for r in board] == sorted((r["cv_auc_mean"] for r in board), reverse=True)
    assert trained.winner == board[0]["model"] and trained.holdout_auc > 0.6
    assert trained.leaderboard_table(spark).count() == 2
    probabilities = trained.transform(features.sla_features(cases, AS_OF)).agg(F.min("sla_breach_prob"), F.max("sla_breach_prob")).first()
    assert 0.0 <= probabilities[0] <= probabilities[1] <= 1.0


def test_stacking_and_importances(prepared):
    table, encoder, rows = prepared
    pool = breach.candidates(SMALL)
    model = breach.fit_stacking(rows, pool, folds=2)
    auc, accuracy = breach._scores(model.transform(rows))
    assert auc > 0.7 and accuracy > 0.6
    named = breach.importances(encoder, model, table).collect()
    assert 0 < len(named) <= 30
    assert [r["importance"] for r in named] == sorted((r["importance"] for r in named), reverse=True)
    assert any(r["feature"] == "pct_sla_elapsed" for r in named)


def test_grid_returns_a_grid_point(prepared):
    _, _, rows = prepared
    best, score = breach.tune(rows, {"trees": (2, 3), "depth": (2,)}, folds=2)
    assert best["depth"] == 2 and best["trees"] in (2, 3) and 0.5 < score <= 1.0
    grid = 1
    for values in breach.GRID.values():
        grid *= len(values)
    assert grid == 24


def test_category_model_separates_topics(spark):
    topics = {"UPI": "upi payment to the shop failed", "Loan": "home loan emi schedule wrong", "Card": "crédit card was blocked again"}
    rows = [(i, t + f" note{i % 4}", c) for i in range(60) for c, t in [list(topics.items())[i % 3]]]
    df = spark.createDataFrame(rows, "id int, complaint_text string, category string")
    model = category.fit(df, "labelled")
    assert model.accuracy == 1.0 and model.classes == ["Card", "Loan", "UPI"]
    row = category.second_opinion(spark.createDataFrame([(1, "my CREDIT card", "UPI")], df.schema), model).first()
    assert (row["ml_category"], row["category_confidence"]) == ("Card", "Needs Review")
    assert sum(row["ml_category_all"].values()) == pytest.approx(1.0, abs=0.001)
    assert category.fit(df.where("category = 'UPI'"), "labelled") is None


def test_training_rows_come_from_the_stated_source(spark):
    raw = spark.createDataFrame([(1, "paytm failed")], "id int, complaint_text string")
    known = raw.withColumns({"category": F.lit("Card"), "processed_at": F.lit("x")})
    assert category.training_rows(known, raw, "weak").first()["category"] == "UPI"
    assert category.training_rows(known, raw, "labelled").first()["category"] == "Card"
    with pytest.raises(ValueError, match="unknown source"):
        category.training_rows(known, raw, "either")


def test_sentiment_slot(spark):
    df = spark.createDataFrame([("the worst", "Angry"), ("kindly", "Angry")], "complaint_text string, sentiment string")
    empty = category.sentiment_opinion(df).collect()
    assert [(r["ml_sentiment"], r["sentiment_confidence"]) for r in empty] == [(None, "Unknown")] * 2
    scored = category.sentiment_opinion(df, category.sentiment_scorer_by_rule).collect()
    assert [r["sentiment_confidence"] for r in scored] == ["High Confidence", "Needs Review"]


def test_priority_model_follows_the_composite(cases):
    model = priority.train(cases, AS_OF, rounds=30)
    assert model.r2 > 0.6 and model.mae < 12
    scores = model.score(cases, AS_OF).agg(F.min("priority_score"), F.max("priority_score")).first()
    assert 0 <= scores[0] <= scores[1] <= 100


def test_backfill_touches_processed_rows_only(cases):
    model = priority.train(cases, AS_OF, rounds=3)
    base = cases.withColumn("priority_score", F.lit(-1)).drop("embedding")
    out = backfill(base, AS_OF, priority=model)
    untouched = out.where("processed_at is null").select("priority_score").distinct().collect()
    assert [r[0] for r in untouched] == [-1]
    assert out.where("processed_at is not null and priority_score < 0").count() == 0
    assert out.count() == base.count()


def test_saved_models_score_alike(spark, cases, prepared, tmp_path):
    rows = features.sla_features(cases, AS_OF)
    table, encoder, fitted = prepared
    pool = breach.candidates(SMALL)
    for i, model in enumerate([ensembles.fit_one(fitted, pool["RandomForest"]), breach.fit_stacking(fitted, pool, folds=2)]):
        trained = breach.Trained(encoder, model, "x", [{"model": "x"}], 0.9, 0.8, 10, {"depth": 3})
        trained.save(spark, str(tmp_path / f"breach{i}"))
        again = breach.Trained.load(spark, str(tmp_path / f"breach{i}"))
        assert (again.winner, again.leaderboard, again.tuned) == (trained.winner, trained.leaderboard, trained.tuned)
        scores = [{r["id"]: r["sla_breach_prob"] for r in m.transform(rows).collect()} for m in (trained, again)]
        assert scores[0] == scores[1]
    model = priority.train(cases, AS_OF, rounds=3)
    model.save(spark, str(tmp_path / "priority"))
    again = priority.PriorityModel.load(spark, str(tmp_path / "priority"))
    scores = [{r["id"]: r["priority_score"] for r in m.score(cases, AS_OF).collect()} for m in (model, again)]
    assert scores[0] == scores[1] and again.r2 == model.r2
    texts = spark.createDataFrame([(i, f"{w} is wrong {i}", w) for i in range(30) for w in ("card", "loan")], "id int, complaint_text string, category string")
    model = category.fit(texts, "labelled")
    model.save(spark, str(tmp_path / "category"))
    again = category.CategoryModel.load(spark, str(tmp_path / "category"))
    assert again == model and [tuple(r) for r in again.predict(texts).drop("ml_category_all").collect()] == [tuple(r) for r in model.predict(texts).drop("ml_category_all").collect()]


def test_category_scores_equal_spark_ml(spark):
    """The Column expressions against the vectors and the fitted regression they stand for."""
    import numpy as np

    texts = ["upi payment failed upi", "home loan emi", "credit card blocked card card", "", "word unseen"]
    rows = spark.createDataFrame([(i, texts[i % 3] + f" n{i % 4}", ["UPI", "Loan", "Card"][i % 3]) for i in range(60)], "id int, complaint_text string, category string")
    model = category.fit(rows, "labelled")
    got = model.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, complaint_text string")).collect()
    for row in got:
        words = [w for w in row["complaint_text"].split() if len(w) > 1]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        counts = np.array([terms.count(t) for t in model.vocabulary], float)
        weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * np.array(model.idf)
        weights /= max(np.linalg.norm(weights), 1e-300)
        margins = np.array(model.coefficients) @ weights + np.array(model.intercepts)
        p = np.exp(margins - margins.max())
        p /= p.sum()
        assert row["ml_category_prob"] == pytest.approx(round(float(p.max()), 4), abs=1.1e-4)
        assert row["ml_category"] == model.classes[int(p.argmax())]


def test_rows_to_fit_on_are_chosen_without_sorting_all(spark):
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") % 3).alias("x"))
    possible = split.few(rows.select("id"), 500)
    some = rows.where(possible)
    assert 500 <= some.count() <= 600
    plain = {r["id"] for r in rows.orderBy(split._digest("id", split.SEED), "id").limit(500).collect()}
    assert {r["id"] for r in split.bounded(rows, 500).collect()} == plain
    assert split.bounded(rows, 30_000).count() == 20_000
    twice = rows.unionByName(rows).withColumn("id", F.when(F.col("x") > 0, F.col("id")))
    assert split.bounded(twice, 500).count() == 500


def test_category_labels_are_not_worked_out_again_for_all_rows(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def label(i):
        asked.add(1)
        return "UPI" if i % 2 else "Card"

    words = F.when(F.col("id") % 2 == 1, "upi payment failed").otherwise("card was swallowed")
    rows = spark.range(4000).select("id", label("id").alias("category"), words.alias("complaint_text"))
    model = category.fit(rows, "weak labels", max_iter=3, max_labelled_rows=200)
    assert model.classes == ["Card", "UPI"] and model.balanced_accuracy == 1.0
    assert 4000 <= asked.value < 6000


def test_category_model_is_fitted_on_every_row(spark, monkeypatch):
    """Also on rows without an id and rows that share one; `smallest` would stand for a cut."""
    topics = [("upi payment failed", "UPI"), ("home loan emi", "Loan")]
    rows = [(None if i < 20 else i // 2, f"{topics[i % 2][0]} only{i // 4}", topics[i % 2][1]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, complaint_text string, category string").repartition(3)
    seen = []
    prepared = category._prepared
    monkeypatch.setattr(category, "_prepared", lambda termed, *a: seen.append(termed.count()) or prepared(termed, *a))
    for name in ("few", "bounded"):
        monkeypatch.setattr(category, name, lambda *a, **b: pytest.fail("rows are left out"))
    model = category.fit(df, "labelled", max_iter=5)
    # 190 named ids of each class, a fifth of which is held out.
    assert seen == [400 - 2 * 38] and model.balanced_accuracy == 1.0 and "only1" in model.vocabulary


@pytest.mark.parametrize("ids", ["id", "case when id % 3 > 0 then id % 50 end"])
def test_places_in_ranges_are_those_of_one_sort(spark, ids):
    rows = spark.range(3000).select("id", F.expr(ids).alias("key"), F.when(F.col("id") % 4 > 0, (F.col("id") % 4 > 1).cast("int")).alias("label")).repartition(7)
    got = split.placed(rows, "label", "key", 5).collect()
    order = {r["id"]: (r["label"], r["d"], r["key"] is not None, r["key"]) for r in rows.withColumn("d", split._digest("key", 5)).collect()}
    for label in (None, 0, 1):
        some = sorted((r for r in got if r["label"] == label), key=lambda r: r["_place"])
        assert [r["_place"] for r in some] == list(range(1, len(some) + 1)) and {r["_size"] for r in some} == {len(some)}
        keys = [order[r["id"]][1:] for r in some]
        assert keys == sorted(keys)
