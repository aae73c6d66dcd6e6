"""The cell search against brute force: many blocks, hot customers, copies, both directions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.operators import duplicates, rootcause


def brute(rows, k, earlier):
    units = {r[0]: np.array(r[2], dtype=np.float32).astype(float) for r in rows}
    units = {i: v / np.linalg.norm(v) for i, v in units.items()}
    out = {}
    for cid, customer, vector, order in rows:
        scored = []
        for oid, other, theirs, theirs_order in rows:
            if oid == cid or other != customer or customer is None:
                continue
            if earlier and (theirs_order, oid) > (order, cid):
                continue
            copy = vector == theirs
            similarity = 1.0 if copy else round(float(units[cid] @ units[oid]), 9)
            scored.append((not copy, -similarity, theirs_order, oid))
        out[cid] = [(oid, -s) for _, s, _, oid in sorted(scored)[:k]]
    return out


def fixture(copies: bool):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(180):
        customer = "Walk-in" if i % 3 else f"c{i % 8}" if i % 5 else None
        vector = rng.normal(size=6).astype(np.float32).round(3).tolist()
        if copies and i % 4 == 0:
            vector = [1.0, 0.5, 0.0, 0.0, 0.25, 0.0]
        rows.append((i, customer, vector, (i * 37) % 11))
    return rows


@pytest.mark.parametrize("mode", ["any", "earlier"])
@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("block_rows", [13, 8192])
def test_matches_brute_force(spark, mode, copies, block_rows):
    rows = fixture(copies)
    df = spark.createDataFrame(rows, "id bigint, customer_name string, embedding array<float>, filed bigint")
    found = duplicates.neighbours(df, 3, mode, "filed", block_rows).collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append((r["neighbour"], round(r["similarity"], 9)))
    want = {i: [(o, round(s, 9)) for o, s in n] for i, n in brute(rows, 3, mode == "earlier").items() if n}
    assert got == want


@pytest.mark.parametrize("block_rows", [9, 8192])
def test_rows_that_only_answer(spark, block_rows):
    rows = fixture(True)
    df = spark.createDataFrame(rows, "id bigint, customer_name string, embedding array<float>, filed bigint").withColumn("asks", F.col("id") % 3 == 0)
    found = duplicates.neighbours(df, 3, "any", "filed", block_rows).collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append((r["neighbour"], round(r["similarity"], 9)))
    want = {i: [(o, round(s, 9)) for o, s in n] for i, n in brute(rows, 3, False).items() if n and i % 3 == 0}
    assert got == want


def test_threshold_and_zero_vectors(spark):
    rows = [(1, "A", [1.0, 0.0]), (2, "A", [0.8, 0.6]), (3, "A", [0.0, 1.0]), (4, "A", [0.0, 0.0]), (5, "B", [1.0, 0.0]), (6, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, customer_name string, embedding array<float>")
    got = {r["id"]: (r["duplicate_of"], r["similarity"]) for r in duplicates.detect(df).collect()}
    assert got == {1: (2, 0.8), 2: (1, 0.8), 3: (None, 0.6), 4: (None, 0.0), 5: (None, 0.0), 6: (None, 0.0)}
    assert duplicates.neighbours(df, exclude=["A"]).count() == 0
    only_earlier = {r["id"]: r["duplicate_of"] for r in duplicates.detect(df, mode="earlier").collect()}
    assert only_earlier[1] is None and only_earlier[2] == 1


def test_a_case_never_points_to_itself_and_order_of_rows_is_irrelevant(spark):
    df = spark.createDataFrame(fixture(True), "id bigint, customer_name string, embedding array<float>, filed bigint")
    one = {tuple(r) for r in duplicates.detect(df, 0.5).collect()}
    two = {tuple(r) for r in duplicates.detect(df.repartition(7, "id").orderBy(F.desc("id")), 0.5, block_rows=20).collect()}
    assert one == two and all(r[0] != r[1] for r in one)


def test_clustered_vectors_visit_less_than_half_of_the_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, "hot", (centres[i % 12] + rng.normal(scale=0.05, size=8)).astype(np.float32).tolist(), i) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, customer_name string, embedding array<float>, filed bigint")
    work = duplicates.search_work(df, 3, 40).collect()
    assert [r["customer_name"] for r in work] == ["hot"] and work[0]["blocks"] > 20
    assert 900 <= work[0]["visited"] < work[0]["pairs"] / 2
    got: dict = {}
    for r in duplicates.neighbours(df, 3, "any", "filed", 40).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], round(r["similarity"], 9)))
    assert got == {i: [(o, round(s, 9)) for o, s in n] for i, n in brute(rows, 3, False).items()}
    assert duplicates.search_work(df, 3).count() == 0


def test_a_row_moves_once_per_cell_however_small_the_blocks(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "hot", rng.normal(size=8).astype(np.float32).tolist(), i) for i in range(800)]
    df = spark.createDataFrame(rows, "id bigint, customer_name string, embedding array<float>, filed bigint")
    embedded, keyed = duplicates._keyed(df, "filed", ())
    large = duplicates._placed(duplicates._heads_of(keyed, 3), embedded, 16)[1]
    schema = duplicates._found_schema(df)
    assert duplicates._search_large(large, 3, False, 16, schema)[1].count() <= 800
    found, visits, indexed = duplicates._search_large(large, 3, True, 16, schema, cell_rows=100)
    cells = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}
    assert 8 <= len(cells) <= 16 and max(cells.values()) <= 200 and visits.count() <= 800 * len(cells)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append((-r["score"], r["neighbour"]))
    best = {i: [(o, round(-s / 10 ** 9, 9)) for s, o in sorted(n)[:3]] for i, n in got.items()}
    assert best == {i: [(o, round(s, 9)) for o, s in n] for i, n in brute(rows, 3, True).items() if n}


def test_a_customer_that_fits_a_cell_is_searched_there(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "hot", rng.normal(size=8).astype(np.float32).tolist(), i) for i in range(600)]
    rows += [(600 + i, "cold", rng.normal(size=8).astype(np.float32).tolist(), i) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, customer_name string, embedding array<float>, filed bigint")
    stored = []
    monkeypatch.setattr(duplicates, "cut_lineage", lambda x, kept=duplicates.cut_lineage: stored.append(x.columns) or kept(x))
    found = duplicates.neighbours(df, 3, "any", "filed", 50)
    assert len(stored) == 2 and not any("embedding" in columns for columns in stored)
    got: dict = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], round(r["similarity"], 9)))
    assert got == {i: [(o, round(s, 9)) for o, s in n] for i, n in brute(rows, 3, False).items()}


@pytest.mark.parametrize("mode", ["any", "earlier"])
@pytest.mark.parametrize("copies", [False, True])
def test_customers_above_a_cell_match_brute_force(spark, mode, copies):
    rows = fixture(copies)
    df = spark.createDataFrame(rows, "id bigint, customer_name string, embedding array<float>, filed bigint")
    got: dict = {}
    for r in duplicates.neighbours(df, 3, mode, "filed", 7, cell_rows=20).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], round(r["similarity"], 9)))
    assert got == {i: [(o, round(s, 9)) for o, s in n] for i, n in brute(rows, 3, mode == "earlier").items() if n}


def test_the_search_inside_a_cell_equals_one_comparison():
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(5, 6))[rng.integers(0, 5, 400)] + rng.normal(scale=0.05, size=(400, 6))
    rows[rng.integers(0, 400, 120)] = rows[3]
    rows[17] = np.nan
    copies = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    places, asks = np.arange(400), np.arange(400) % 3 > 0
    for earlier in (False, True):
        for block_rows in (7, 60):
            found, score, blocks, visited = duplicates._indexed_best(rows, asks, copies, 4, earlier, block_rows)
            want, want_score = duplicates._best(rows[asks], rows, places[asks], places, copies[asks], copies, 4, earlier)
            pairs = [sorted(zip(-s[f >= 0], f[f >= 0])) for f, s in zip(found[asks], score[asks])]
            assert pairs == [sorted(zip(-s[f >= 0], f[f >= 0])) for f, s in zip(want, want_score)]
            assert (found[~asks] == -1).all() and asks.sum() <= visited < blocks * asks.sum()


def test_cells_of_a_hot_customer(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 70, "hot").otherwise("cold").alias("customer_name"))
    got = {r["customer_name"]: (r["vectors"], r["cells"]) for r in duplicates.block_sizes(df, 20).collect()}
    assert got == {"hot": (70, 10), "cold": (30, 3)}


def test_text_vectors_have_unit_length(spark):
    df = spark.createDataFrame([(1, "card lost in atm"), (2, "card lost in atm"), (3, "loan emi late")], "id int, t string")
    rows = {r["id"]: np.array(r["embedding"]) for r in duplicates.text_vectors(df, "t", 64).collect()}
    assert np.allclose(np.linalg.norm(rows[1]), 1.0, atol=1e-5)
    assert rows[1] @ rows[2] > 0.99 > rows[1] @ rows[3]


def test_clusters_of_separated_points(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        centre = np.eye(4)[i % 3]
        rows.append((i, "UPI" if i % 3 == 0 else "Card", "Pune" if i % 3 == 0 else f"city{i % 7}", (centre + rng.normal(scale=0.01, size=4)).astype(float).tolist()))
    df = spark.createDataFrame(rows, "id int, category string, location string, embedding array<double>")
    labelled = rootcause.assign_clusters(df, k=3, restarts=3)
    sizes = sorted(r["count"] for r in labelled.groupBy("cluster_id").count().collect())
    assert sizes == [20, 20, 20]
    alerts = rootcause.alerts(labelled).collect()
    assert len(alerts) == 3
    pune = next(a for a in alerts if a["category"] == "UPI")
    assert pune["location"] == "Pune"
    assert pune["summary"] == "20 UPI complaints concentrated in Pune (100% of cluster) -- possible local UPI service issue."


def test_few_vectors_raise_no_alert(spark):
    df = spark.createDataFrame([(1, "UPI", "x", [1.0])], "id int, category string, location string, embedding array<float>")
    assert rootcause.detect(df).count() == 0


def test_alert_texts(spark):
    rows = [(0, "Loan", c) for c in ["A", "A", "B", "B", "C", "D", "E", "F"]] + [(1, "ATM", None)] * 5
    rows += [(2, "UPI", "X"), (2, "UPI", "X"), (2, "Card", "X"), (2, "Card", "X"), (2, "UPI", "Y")]
    df = spark.createDataFrame(rows, "cluster_id int, category string, location string")
    got = {r["cluster_id"]: (r["location"], r["summary"]) for r in rootcause.alerts(df).collect()}
    assert got[0] == (None, "8 Loan complaints across 6 cities. Top hotspots: A (2), B (2), C (1) + 3 elsewhere. Possible systemic Loan issue.")
    assert got[1] == ("Unknown", "5 ATM complaints concentrated in Unknown (100% of cluster) -- possible local ATM service issue.")
    assert got[2][0] == "X"
