"""The booster over many tasks against the same trees grown on one table, and the priority model that rests on it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.models import boosting


def plain(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, step: float) -> np.ndarray:
    """Predictions of trees whose cuts are all values, by a loop over nodes."""
    out = np.zeros(len(y))
    for t in range(rounds):
        rest, value = y - out, np.zeros(len(y))
        open_ = [(np.arange(len(y)), 0)]
        while open_:
            rows, level = open_.pop()
            best = (1e-9, None)
            for f in range(x.shape[1] if level < depth else 0):
                for cut in np.unique(x[rows, f])[:-1]:
                    goes = x[rows, f] <= cut
                    a, b = rest[rows[goes]], rest[rows[~goes]]
                    gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - rest[rows].sum() ** 2 / len(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, goes)
            if best[1] is None:
                value[rows] = rest[rows].mean()
            else:
                open_ += [(rows[best[1]], level + 1), (rows[~best[1]], level + 1)]
        out += value * (2 * step if t else 1.0)
    return out


@pytest.fixture
def rows(spark):
    draw = np.random.default_rng(3)
    x = np.column_stack([draw.integers(0, 3, 600), draw.integers(0, 2, 600), draw.integers(0, 40, 600), np.full(600, 7)]).astype(float)
    y = 5 * x[:, 0] - 3 * x[:, 1] * (x[:, 2] > 11) + np.sqrt(x[:, 2]) + draw.normal(scale=0.01, size=600)
    # Ids repeat and are missing.
    table = [(None if i % 3 else i % 5, float(y[i]), *x[i].tolist()) for i in range(600)]
    return x, y, spark.createDataFrame(table, "id long, label double, a double, b double, c double, d double").repartition(8)


def test_trees_over_many_tasks_are_those_of_one_table(spark, rows, monkeypatch):
    x, y, frame = rows
    monkeypatch.setattr(boosting, "LEAST_ROWS", 80)
    monkeypatch.setattr(boosting, "FRESH", 3)
    model = boosting.fit(frame, ["a", "b", "c", "d"], rounds=8, depth=3, step=0.1, share=1.0, seed=1)
    assert len(model.values) == 8 and {len(v) for v in model.values} == {8}
    got = {(r["label"]): r["prediction"] for r in model.transform(frame).collect()}
    want = plain(x, y, 8, 3, 0.1)
    assert max(abs(got[float(a)] - b) for a, b in zip(y, want, strict=True)) < 1e-9


def test_a_sample_of_rows_and_one_value(spark, rows):
    x, y, frame = rows
    model = boosting.fit(frame, ["a", "b", "c", "d"], rounds=40, depth=4, step=0.1, share=0.9, seed=1)
    error = model.transform(frame).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    assert error < 0.1
    flat = boosting.fit(frame.withColumn("label", F.lit(2.5)), ["d"], rounds=2, depth=2, step=0.1, share=1.0, seed=1)
    assert [r[0] for r in flat.transform(frame).select("prediction").distinct().collect()] == [2.5]
    with pytest.raises(ValueError):
        boosting.fit(frame.where("a > 9"), ["a"], rounds=1, depth=2, step=0.1, share=1.0, seed=1)
