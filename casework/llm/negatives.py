"""Hard negatives of anchors, found by segment summaries that bound scores before any score is computed.

Components are whole numbers. Every vector is stored with a pyramid of summaries: for 1, 4 and 16 segments, each segment's mean and deviation
(the root of the sum of squared differences from that mean). For two vectors a and b, the part of their inner product that a segment of L components
adds lies within L * mean(a) * mean(b) plus or minus deviation(a) * deviation(b), so the sum over segments bounds the score from both sides. A pair
survives a level if its bounds can reach the wanted scores: above the lowest wanted one, below the highest, and not below the bounds of as many rows
as are wanted that certainly qualify. Only survivors are summarised more finely, and only survivors of the last level are scored exactly.

Rows lie in cells of bounded size, and anchors are dealt to every cell that can hold a row for them: for positives the cells of their label, for negatives
all cells. A task holds one cell and streams the anchors past it; it returns the best few rows of the cell per anchor, and a window over these gives the best of all.
The work is (anchors x rows), as the question is, but no anchor or row passes the driver and no task holds more than a cell and a batch of anchors.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; a shorter vector counts as padded with
zeros; an empty one scores zero with all. Rows that share the anchor's id are not "other rows". Repeated rows count one by one, as candidates and as anchors. An
anchor without positives, or without rows in the score range, gives no row; an empty table an empty result. A score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import stored

LEVELS = (1, 4, 16)
#: Anchors that are compared with a cell at a time.
BATCH = 256
_FOUND = "anchor long, digest long, place int, id long, score long"


class Pyramid:
    """Whole-number vectors as rows of a matrix, with their summaries by level."""

    def __init__(self, vectors: list[np.ndarray], width: int) -> None:
        self.values = np.zeros((len(vectors), width), np.int64)
        for row, vector in zip(self.values, vectors, strict=True):
            row[:len(vector)] = vector
        self.floats = self.values.astype(np.float64)
        self.norms = np.sqrt((self.floats ** 2).sum(axis=1))
        self.levels = [self._level(min(m, max(width, 1))) for m in LEVELS]

    def _level(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean times the root of the segment's length, and deviation, of each segment."""
        edges = np.linspace(0, self.floats.shape[1], segments + 1).astype(int)
        means, deviations = [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = self.floats[:, a:b]
            mean = part.mean(axis=1) if b > a else np.zeros(len(part))
            means.append(mean * np.sqrt(b - a))
            deviations.append(np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1)))
        return np.column_stack(means), np.column_stack(deviations)


def exact(a: Pyramid, b: Pyramid) -> np.ndarray:
    """All inner products, as 64-bit whole numbers."""
    largest = float(a.norms.max(initial=0) * b.norms.max(initial=0))
    if largest < 2.0 ** 52:  # no partial sum is larger, so double precision holds them all
        return (a.floats @ b.floats.T).astype(np.int64)
    return a.values @ b.values.T


def _pairs(a: Pyramid, b: Pyramid, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of given pairs."""
    out = np.empty(len(left), np.int64)
    for at in range(0, len(left), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("ij,ij->i", a.values[left[s]], b.values[right[s]])
    return out


def survivors(a: Pyramid, b: Pyramid, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: int) -> tuple[np.ndarray, list[int]]:
    """Pairs that may be among the `wanted` highest scores in [low, high] of their anchor, and how many each level left.

    `low` and `high` are given per anchor; `allowed` is the matrix of pairs in question.
    """
    alive, left = allowed.copy(), [int(allowed.sum())]
    for (mean_a, dev_a), (mean_b, dev_b) in zip(a.levels, b.levels, strict=True):
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            break
        middle, spread = mean_a[rows] @ mean_b[columns].T, dev_a[rows] @ dev_b[columns].T
        # Room for rounding: the bounds are real numbers, the scores whole ones.
        spread += 0.5 + 1e-9 * np.outer(a.norms[rows], b.norms[columns])
        part = alive[np.ix_(rows, columns)]
        lo, hi = low[rows, None], high[rows, None]
        under, over = middle - spread, middle + spread
        part &= (over >= lo) & (under <= hi)
        if part.shape[1] > wanted:
            certain = np.where(part & (under >= lo) & (over <= hi), under, -np.inf)
            part &= over >= np.partition(certain, part.shape[1] - wanted, axis=1)[:, [part.shape[1] - wanted]]
        alive[np.ix_(rows, columns)] = part
        left.append(int(part.sum()))
    return alive, left


def _scored(a: Pyramid, b: Pyramid, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor number, row number and exact score of the survivors: one matrix product where they are dense, else pair by pair."""
    if float(a.norms.max(initial=0) * b.norms.max(initial=0)) >= 2.0 ** 62:
        raise OverflowError("scores do not fit 64 bits")
    left, right = np.nonzero(alive)
    if len(left) * 8 < alive.size:
        return left, right, _pairs(a, b, left, right)
    return left, right, exact(a, b)[left, right]


class _Cell:
    """The rows of one cell, in the order of their ids, so that a stable sort by score breaks ties by id."""

    def __init__(self, ids: list[np.ndarray], labels: list[np.ndarray], vectors: list[np.ndarray]) -> None:
        self.ids, self.labels = np.concatenate(ids), np.concatenate(labels)
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.labels, vectors = self.ids[order], self.labels[order], [vectors[i] for i in order]
        self.width = max(map(len, vectors), default=0)
        self.pyramid = Pyramid(vectors, self.width)

    def _both(self, vectors: list[np.ndarray]) -> tuple[Pyramid, Pyramid]:
        """Both sides at one width: components that only one side has add nothing."""
        return Pyramid([v[:self.width] for v in vectors], self.width), self.pyramid

    def positives(self, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], wanted: int) -> Iterator[tuple]:
        a, b = self._both(vectors)
        allowed = (labels[:, None] == self.labels[None]) & (ids[:, None] != self.ids[None])
        free = np.full(len(ids), np.inf)
        left, right, score = _scored(a, b, survivors(a, b, allowed, -free, free, wanted)[0])
        order = np.lexsort((right, -score, left))
        starts = np.searchsorted(left[order], np.arange(len(ids) + 1))
        for i in range(len(ids)):
            best = order[starts[i]:min(starts[i + 1], starts[i] + wanted)]
            if len(best):
                yield i, 0, self.ids[right[best]], score[best]

    def negatives(self, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], scores: list[np.ndarray], wanted: int,
                  window: tuple[int, int]) -> Iterator[tuple]:
        """Per anchor and place of a positive: rows with window[0] * positive <= 100 * score <= window[1] * positive."""
        a, b = self._both(vectors)
        allowed = labels[:, None] != self.labels[None]
        # Whole scores that satisfy the two conditions of the widest window.
        low = [[-(-window[0] * int(s) // 100) for s in row] for row in scores]
        high = [[window[1] * int(s) // 100 for s in row] for row in scores]
        widest = (np.array([min(r, default=1) for r in low], np.float64), np.array([max(r, default=0) for r in high], np.float64))
        # A row in the highest window need not be in a lower one, so no count of certain rows may discard here beyond all windows together.
        per_anchor = wanted if all(len(r) < 2 for r in low) else len(self.ids)
        left, right, score = _scored(a, b, survivors(a, b, allowed, *widest, per_anchor)[0])
        order = np.lexsort((right, -score, left))
        starts = np.searchsorted(left[order], np.arange(len(ids) + 1))
        for i in range(len(ids)):
            mine = order[starts[i]:starts[i + 1]]
            falling = -score[mine]
            for place, (lo, hi) in enumerate(zip(low[i], high[i], strict=True)):
                first, last = np.searchsorted(falling, -hi, "left"), np.searchsorted(falling, -lo, "right")
                best = mine[first:min(last, first + wanted)]
                if len(best):
                    yield i, place, self.ids[right[best]], score[best]


def _in_cells(batches: Iterator[pa.RecordBatch], wanted: int, window: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """Input is sorted by cell, and in a cell its rows come before its anchors."""

    def out(found: Iterator[tuple], ids: np.ndarray, digests: np.ndarray) -> pa.RecordBatch:
        parts = [(i, place, len(r), r, s) for i, place, r, s in found]
        sizes = [n for _, _, n, _, _ in parts]
        who = np.repeat(np.array([i for i, *_ in parts], np.int64), sizes)
        columns = [
            pa.array(ids[who]), pa.array(digests[who]), pa.array(np.repeat(np.array([p for _, p, *_ in parts], np.int32), sizes)),
            pa.array(np.concatenate([r for *_, r, _ in parts] or [np.array([], np.int64)])),
            pa.array(np.concatenate([s for *_, s in parts] or [np.array([], np.int64)])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "digest", "place", "id", "score"])

    def lists(column: pa.Array) -> list[np.ndarray]:
        flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [flat[p:q] for p, q in zip(offsets[:-1], offsets[1:], strict=True)]

    here, held, cell = None, ([], [], []), None
    for batch in batches:
        first, second = (batch.column(i).to_numpy() for i in range(2))
        changes = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
        for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if here != (key := (int(first[a]), int(second[a]))):
                here, held, cell = key, ([], [], []), None
            part = batch.slice(a, b - a)
            is_anchor = part.column(2).to_numpy(zero_copy_only=False)
            cut = int(is_anchor.argmax()) if is_anchor.any() else len(is_anchor)
            if cut:
                rows = part.slice(0, cut)
                held[0].append(rows.column(3).to_numpy())
                held[1].append(rows.column(5).to_numpy())
                held[2].extend(v.copy() for v in lists(rows.column(6)))
            if cut == len(is_anchor) or not held[2]:
                continue
            cell = cell or _Cell(*held)
            for at in range(cut, len(is_anchor), BATCH):
                some = part.slice(at, BATCH)
                ids, labels, vectors = some.column(3).to_numpy(), some.column(5).to_numpy(), lists(some.column(6))
                found = (
                    cell.positives(ids, labels, vectors, wanted) if window is None
                    else cell.negatives(ids, labels, vectors, lists(some.column(7)), wanted, window)
                )
                yield out(found, ids, some.column(4).to_numpy())


def whole_numbers(df: DataFrame, key: str, vector: str, label: str, scale: int = 256) -> DataFrame:
    """id, label, v of the rows that take part; v are the components times `scale`, rounded down."""
    numbers = F.col(vector).cast("array<double>")
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), numbers.alias("n"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("n").isNotNull() & sound)
    return rows.select("id", "label", F.transform("n", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _compared(rows: DataFrame, anchors: DataFrame, wanted: int, window: tuple[int, int] | None) -> DataFrame:
    """Best rows of each cell. `rows` have c1, c2, id, label, v; `anchors` besides digest and scores."""
    layout = ("c1", "c2", "is_anchor", "id", "digest", "label", "v", "scores")
    mine = rows.select("c1", "c2", F.lit(False).alias("is_anchor"), "id", F.lit(0).cast("long").alias("digest"), "label", "v",
                       F.array().cast("array<long>").alias("scores"))
    both = mine.unionByName(anchors.withColumn("is_anchor", F.lit(True)).select(*layout))
    dealt = both.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "is_anchor")
    return dealt.mapInArrow(partial(_in_cells, wanted=wanted, window=window), _FOUND)


def _first(found: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("anchor", "digest", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)


def mine(vectors: DataFrame, is_anchor: Column, key: str = "id", label: str = "label", vector: str = "v", positives: int = 5, negatives: int = 10,
         window: tuple[int, int] = (30, 90), cell_rows: int = 1 << 16) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has whole-number vectors (`whole_numbers`); `is_anchor` picks the anchors by `id`. Positives are the first rows of the anchor's label by
    score, then id; negatives the first of other labels whose score is within `window` percent of the positive's. `cell_rows` bounds a cell; smaller
    tables get cells enough for every task.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")), "vectors")
    sizes = stored(rows.groupBy("label").agg(F.count("*").alias("size")), "labels")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(-(-total // cell_rows), min(-(-total // 256), tasks), 1)
    room = max(-(-total // cells), 1)
    parts = sizes.select("label", F.ceil(F.col("size") / room).cast("int").alias("parts"))
    place = F.xxhash64("id", "v")

    # Equal anchors are asked once and answered as often as they occur.
    anchors = rows.filter(is_anchor).groupBy("id", "label", "v").agg(F.count("*").cast("int").alias("copies"))
    anchors = stored(anchors.withColumn("digest", F.xxhash64("label", "v")), "anchors")
    none = F.array().cast("array<long>")
    by_label = rows.join(parts, "label").select(F.col("label").alias("c1"), F.pmod(place, "parts").alias("c2"), "id", "label", "v")
    asked = anchors.join(parts, "label").select(
        F.col("label").alias("c1"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long"))).alias("c2"), "id", "digest", "label", "v",
        none.alias("scores"),
    )
    near = stored(_first(_compared(by_label, asked, positives, None), positives), "positives")

    listed = near.groupBy("anchor", "digest").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    ready = stored(
        anchors.join(listed, (anchors["id"] == listed["anchor"]) & (anchors["digest"] == listed["digest"])).select(
            anchors["id"], anchors["digest"], "label", "v", "copies", "p",
        ), "asked",
    )
    spread = rows.select(F.lit(0).cast("long").alias("c1"), F.pmod(place, F.lit(cells)).alias("c2"), "id", "label", "v")
    asked = ready.select(
        F.lit(0).cast("long").alias("c1"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("c2"), "id", "digest", "label", "v",
        F.transform("p", lambda x: x["score"]).alias("scores"),
    )
    best = _first(_compared(spread, asked, negatives, window), negatives).withColumnRenamed("id", "negative_id")
    told = ready.select(F.col("id").alias("anchor"), "digest", "copies", F.posexplode("p").alias("place", "q"))
    return best.join(told, ["anchor", "digest", "place"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("anchor").alias("anchor_id"), F.col("q.id").alias("positive_id"), "rank", "negative_id",
        F.col("q.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
