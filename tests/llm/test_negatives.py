"""Hard negatives against plain loops over whole numbers."""

from __future__ import annotations

import random
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, id string"


def plain(rows: list[tuple], asks) -> list[tuple]:
    sound = [(k, y, [floor(256 * float(np.float32(x))) for x in v]) for k, y, v in rows
             if k is not None and y is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for k, y, v in sound:
        if not asks(k):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), i, z) for i, z, w in sound if i != k]
        near = sorted((-s, i) for s, i, z in scored if z == y)[:5]
        for s, i in near:
            far = sorted((-t, j) for t, j, z in scored if z != y and 30 * -s <= 100 * t <= 90 * -s)[:10]
            out += [(k, i, r, j, -s, -t) for r, (t, j) in enumerate(far, 1)]
    return sorted(out)


def found(spark, rows: list[tuple], asks, **options) -> list[tuple]:
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    vectors = negatives.whole_numbers(df, "vec_id", "embedding", "label")
    return sorted(map(tuple, negatives.mine(vectors, asks, **options).collect()))


@pytest.mark.parametrize("cell_rows", [7, 1 << 16])
def test_equals_loops(spark, cell_rows):
    draw = random.Random(1)
    centres = [[draw.gauss(0, 1) for _ in range(20)] for _ in range(4)]
    rows = []
    for i in range(300):
        c = draw.choice(centres)
        rows.append((i, draw.randrange(3), [round(x + draw.gauss(0, 0.4), 2) for x in c]))
    # Ties, repeated rows, a hot label, and the rows that take no part.
    rows += [(1000 + i, 1, rows[5][2]) for i in range(40)] + [rows[10], rows[10], (20, 2, rows[11][2])]
    rows += [(None, 1, [1.0]), (2000, None, [1.0]), (2001, 1, None), (2002, 1, [None, 1.0]), (2003, 1, [float("nan")]), (2004, 1, [float("inf")])]
    rows += [(2010, 0, []), (2020, 1, [1.0, 2.0]), (2030, 2, [0.0] * 20), (-40, 7, [1.0] * 20)]
    assert found(spark, rows, F.col("id") % 10 == 0, cell_rows=cell_rows) == plain(rows, lambda k: k % 10 == 0) != []


def test_large_numbers(spark):
    rows = [(i, i % 2, [float(2 ** 22 + i), float(2 ** 22 - 3 * i), 1.0]) for i in range(30)]
    assert found(spark, rows, F.col("id") % 5 == 0, window=(30, 90)) == plain(rows, lambda k: k % 5 == 0)


def test_empty(spark):
    assert found(spark, [], F.col("id") % 10 == 0) == found(spark, [(1, 1, [1.0])], F.col("id") % 10 == 0) == []


def test_bounds_lose_nothing_and_discard():
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 100, (8, 4)).repeat(8, axis=1)
    values = np.floor(centres[draw.integers(0, 8, 400)] + draw.normal(0, 10, (400, 32))).astype(np.int64)
    a, b = negatives.Pyramid(list(values[:20]), 32), negatives.Pyramid(list(values), 32)
    truth = values[:20] @ values.T
    assert (negatives.exact(a, b) == truth).all()
    for (mean_a, dev_a), (mean_b, dev_b) in zip(a.levels, b.levels):
        assert (np.abs(truth - mean_a @ mean_b.T) <= dev_a @ dev_b.T + 1).all()
    low, high = np.full(20, 30_000.0), np.full(20, 90_000.0)
    alive, left = negatives.survivors(a, b, np.ones((20, 400), bool), low, high, 400)
    assert not (~alive & (truth >= 30_000) & (truth <= 90_000)).any()
    assert left[-1] < left[0] / 2
    best, kept = negatives.survivors(a, b, np.ones((20, 400), bool), np.full(20, -np.inf), np.full(20, np.inf), 5)
    fifth = np.sort(truth, axis=1)[:, -5]
    assert not (~best & (truth > fifth[:, None])).any() and kept[-1] < kept[0] / 2
