"""Boosted regression trees on every row of a table, for K16.

Features are binned to a byte once. A level of a tree is one Spark job: each task sums residuals and counts by node and bin, and what reaches the driver is
these sums, whose size depends on bins and nodes but not on rows. A round's residuals are a cached RDD made from those of the round before; every `FRESH` rounds
they are made from the stored blocks and all trees so far, so that no lineage grows with the rounds.

The settings have the meaning of Spark's GBTRegressor: the first tree is taken whole, and the derivative of the squared error doubles the step of the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.models.ensembles import binned
from casework.session import cut_lineage

BINS, CHUNK, FRESH = 255, 65_536, 25
#: Rows of a task: this many at least, if there are as many, and at most.
LEAST_ROWS, MOST_ROWS = 32_768, 4_194_304
_BLOCKS = "rows long, labels binary, bins binary"
#: Nothing lies above this bin, so a node that is not split sends all its rows to the left.
_NO_CUT = 255


@dataclass(frozen=True)
class Boosted:
    """Trees of equal depth as arrays: the nodes level by level from the root, then the values of the leaves."""

    columns: list[str]
    cuts: list[list[float]]
    depth: int
    features: list[list[int]]
    bounds: list[list[int]]
    values: list[list[float]]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Predictions for bins (features x rows)."""
        out = np.zeros(bins.shape[1])
        for feature, bound, value in zip(self.features, self.bounds, self.values, strict=True):
            out += np.asarray(value)[_place(bins, feature, bound, self.depth)]
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with `prediction`."""
        me = self

        @F.pandas_udf("double")
        def score(values: pd.DataFrame) -> pd.Series:
            return pd.Series(me.predict(np.ascontiguousarray(binned(values.to_numpy(np.float64), me.cuts).T)))

        return rows.withColumn("prediction", score(F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns])))

    def facts(self) -> dict:
        return asdict(self)


def _place(bins: np.ndarray, feature: Sequence[int], bound: Sequence[int], depth: int) -> np.ndarray:
    """Which of the 2 ** depth nodes of a level each row reaches."""
    place = np.zeros(bins.shape[1], np.uint8)
    for level in range(depth):
        first, right = 2 ** level - 1, np.zeros(len(place), bool)
        for j in range(2 ** level):
            right |= (place == j) & (bins[feature[first + j]] > bound[first + j])
        place = 2 * place + right
    return place


def feature_cuts(rows: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Upper ends of each column's bins but the last, from quantiles of all rows."""
    shares = [k / BINS for k in range(1, BINS)]
    value = {c: F.col(c).cast("double") for c in columns}
    found = rows.agg(*[F.struct(F.percentile_approx(v, shares, 10_000).alias("cuts"), F.max(v).alias("top")).alias(c) for c, v in value.items()]).first()
    return [sorted({x for x in found[c]["cuts"] or () if x == x and not x >= found[c]["top"]}) for c in columns]


def _bundles(sizes: Sequence[int]) -> list[list[int]]:
    """Features whose bins together fit in one byte: one pass counts them all."""
    out: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: sizes[f]):
        if out and np.prod([sizes[g] for g in out[-1]]) * sizes[f] <= 256:
            out[-1].append(f)
        else:
            out.append([f])
    return out


def _blocks(rows: DataFrame, columns: Sequence[str], cuts: list[list[float]], bundles: list[list[int]]) -> DataFrame:
    """The rows as stored blocks: labels, and a byte per feature and bundle."""
    sizes = [len(c) + 1 for c in cuts]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, *values = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            bins = np.ascontiguousarray(binned(np.column_stack(values), cuts).T)
            codes = [np.ravel_multi_index([bins[f] for f in b], [sizes[f] for f in b]).astype(np.uint8) for b in bundles if len(b) > 1]
            table = np.vstack([bins, *codes])
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(label)], pa.int64()), pa.array([label.astype(np.float64).tobytes()], pa.binary()), pa.array([table.tobytes()], pa.binary())],
                ["rows", "labels", "bins"],
            )

    return cut_lineage(rows.select(F.col("label").cast("double"), *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(pack, _BLOCKS))


def _loaded(blocks: DataFrame, parts: int) -> RDD:
    """(number, residuals, bins) per task; before the first tree the residuals are the labels."""
    def load(number: int, some) -> Iterator[tuple]:
        some = list(some)
        if some:
            labels = np.concatenate([np.frombuffer(b["labels"], np.float64) for b in some])
            yield number, labels, np.hstack([np.frombuffer(b["bins"], np.uint8).reshape(-1, b["rows"]) for b in some])

    return blocks.repartition(parts).rdd.mapPartitionsWithIndex(load)


def _sums(feature: list[int], bound: list[int], level: int, codes: list[tuple[int, int]], share: float, seed: list[int]):
    """Per bundle the counts and the sums of residuals by node and code, of the rows that the tree's sample holds."""
    def run(block: tuple) -> list[np.ndarray]:
        number, residual, bins = block
        drawn = (np.random.default_rng([*seed, number]).random(len(residual), np.float32) < share).astype(np.float64)
        out = [np.zeros((2, 2 ** level * size)) for _, size in codes]
        for a in range(0, len(residual), CHUNK):
            some, n = bins[:, a:a + CHUNK], drawn[a:a + CHUNK]
            place, g = _place(some, feature, bound, level).astype(np.int64), residual[a:a + CHUNK] * n
            for total, (row, size) in zip(out, codes, strict=True):
                key = place * size + some[row]
                total[0] += np.bincount(key, n, total.shape[1])
                total[1] += np.bincount(key, g, total.shape[1])
        return out

    return run


def _without(trees: list[tuple[list[int], list[int], list[float]]], depth: int):
    """Residuals that the trees leave."""
    def run(block: tuple) -> tuple:
        number, residual, bins = block
        left = np.empty(len(residual))
        for a in range(0, len(residual), CHUNK):
            some, now = bins[:, a:a + CHUNK], residual[a:a + CHUNK].copy()
            for feature, bound, value in trees:
                now -= np.asarray(value)[_place(some, feature, bound, depth)]
            left[a:a + CHUNK] = now
        return number, left, bins

    return run


def _best(n: list[np.ndarray], g: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, bound and both children's mean residuals per node, from counts and sums (nodes x bins) per feature."""
    nodes = len(n[0])
    all_n, all_g = n[0].sum(axis=1), g[0].sum(axis=1)
    mean = all_g / np.maximum(all_n, 1)
    gain, feature, bound = np.full(nodes, 1e-9), np.zeros(nodes, np.int64), np.full(nodes, _NO_CUT)
    left, right, each = mean.copy(), np.zeros(nodes), np.arange(nodes)
    for f, (fn, fg) in enumerate(zip(n, g, strict=True)):
        if fn.shape[1] < 2:
            continue
        ln, lg = fn[:, :-1].cumsum(axis=1), fg[:, :-1].cumsum(axis=1)
        rn, rg = all_n[:, None] - ln, all_g[:, None] - lg
        lm, rm = lg / np.maximum(ln, 1), rg / np.maximum(rn, 1)
        value = np.where((ln > 0) & (rn > 0), lg * lm + rg * rm - (all_g * mean)[:, None], 0.0)
        at = value.argmax(axis=1)
        better = value[each, at] > gain
        gain[better], feature[better], bound[better] = value[each, at][better], f, at[better]
        left[better], right[better] = lm[each, at][better], rm[each, at][better]
    return feature, bound, left, right


def fit(rows: DataFrame, columns: Sequence[str], rounds: int, depth: int, step: float, share: float, seed: int) -> Boosted:
    """Trees that predict `label` from the columns, none of which may be missing; each tree sees a `share` of the rows."""
    spark = rows.sparkSession
    cuts = feature_cuts(rows, columns)
    sizes = [len(c) + 1 for c in cuts]
    bundles = _bundles(sizes)
    blocks = _blocks(rows, columns, cuts, bundles)
    size = blocks.agg(F.sum("rows")).first()[0]
    if not size:
        raise ValueError("no rows to fit on")
    slots = spark.sparkContext.defaultParallelism
    parts = min(slots, -(-size // LEAST_ROWS)) if size <= slots * MOST_ROWS else slots * -(-size // (slots * MOST_ROWS))
    joint = [b for b in bundles if len(b) > 1]
    codes = [(len(columns) + joint.index(b) if len(b) > 1 else b[0], int(np.prod([sizes[f] for f in b]))) for b in bundles]
    base = state = _loaded(blocks, parts).persist(StorageLevel.MEMORY_AND_DISK)
    model, done, old = Boosted(list(columns), cuts, depth, [], [], []), [], None
    try:
        for t in range(rounds):
            feature, bound, value = [], [], []
            for level in range(depth):
                found = state.map(_sums(feature, bound, level, codes, share, [seed, t])).collect()
                if old is not None:
                    old, _ = None, old.unpersist()
                n, g = [None] * len(columns), [None] * len(columns)
                for i, b in enumerate(bundles):
                    total = np.sum([x[i] for x in found], axis=0).reshape(2, 2 ** level, *[sizes[f] for f in b])
                    for axis, f in enumerate(b, 2):
                        n[f], g[f] = total.sum(axis=tuple(a for a in range(2, total.ndim) if a != axis))
                best = _best(n, g)
                feature, bound = feature + best[0].tolist(), bound + best[1].tolist()
                value = np.stack(best[2:], axis=1).ravel()
            if not np.isfinite(value).all():
                raise ValueError("labels must be finite numbers")
            done.append((feature, bound, (value * (2 * step if t else 1.0)).tolist()))
            if t + 1 < rounds:
                after = base.map(_without(done, depth)) if (t + 1) % FRESH == 0 else state.map(_without(done[-1:], depth))
                old, state = (None if state is base else state), after.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        for rdd in (old, state, base):
            if rdd is not None:
                rdd.unpersist()
    for own, part in zip((model.features, model.bounds, model.values), zip(*done), strict=True):
        own.extend(part)
    return model
