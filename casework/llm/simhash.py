"""SimHash near-duplicates with a pivot distance table.

A fingerprint has 64 bits: a bit is set if it is set in more than half of the XXH64 hashes of the text's word shingles. Exact copies
meet first, so everything after works on distinct fingerprints. For each of them the table holds its Hamming distances to `PIVOTS`
reference fingerprints, computed once. Two fingerprints that differ in at most `RADIUS` bits have no coordinates further apart than
that, so a pair with a larger coordinate difference is discarded unseen, and the rest are verified bit by bit.

Comparing the table with itself would be a cross join, so rows meet only in buckets: the 64 bits are cut into five blocks, and two
fingerprints that differ in three bits or fewer agree on two whole blocks at least; each of the ten pairs of blocks is one bucketing. A bucket above
`CHUNK` rows is cut into chunks, and each pair of chunks is a cell of its own, so a hot bucket is spread over tasks without dropping a pair. Inside a
large bucket rows are sorted by their first coordinate and compared only within the window that this coordinate allows. A
cell returns a spanning forest of its links, not the links, and components are found from these.

Defined cases: null and empty texts have no words and the fingerprint zero, which links like any other; a text of fewer words than a
shingle is one shingle; repeated rows keep a row each; a component without any id has a null component_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import ROW, row_key, stored, text_of
from casework.llm.graph import components
from casework.llm.wordblocks import word_blocks

SEED, RADIUS, CHUNK, SMALL_RUN = 42, 3, 4096, 32
#: Five blocks: of two fingerprints within three bits, two blocks agree.
BLOCKS = tuple(((1 << w) - 1) << s for w, s in ((13, 0), (13, 13), (13, 26), (13, 39), (12, 52)))
MASKS = tuple(a | b for a, b in combinations(BLOCKS, 2))
PIVOTS = tuple(xxhash.xxh64_intdigest(f"pivot {k}".encode(), SEED) for k in range(16))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str, size: int = 3) -> int:
    """Unsigned fingerprint of a text; shingles of `size` words, repeats included."""
    counts, n, carry = np.zeros(64, np.int64), 0, []
    for block in word_blocks(text):
        words = carry + block
        if len(words) < size:
            carry = words
            continue
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        joined, starts = b" ".join(words), (ends - lengths)[: len(words) - size + 1].tolist()
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist(), strict=True)),
            np.uint64, len(starts),
        )
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
        carry = words[len(words) - size + 1:]
    if not n and carry:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(np.packbits(2 * counts > n).view(">u8")[0]) if n else 0


def fingerprints(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """id, digest, fp: one row per row; digest tells rows of one id with different texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["id", "digest", "fp"])

    plain = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text_of(text)).alias("digest"), text_of(text).alias("text"))
    return plain.mapInArrow(run, "id long, digest long, fp long")


def _packed(fp: Column, pivots: tuple[int, ...]) -> Column:
    """Eight distances of a byte each in one long."""
    out = F.lit(0).cast("long")
    for k, pivot in enumerate(pivots):
        distance = F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)))).cast("long")
        out = out.bitwiseOR(F.shiftleft(distance, 8 * k))
    return out


def pivot_table(fps: DataFrame) -> DataFrame:
    """fp, first_id, near, far: one row per distinct fingerprint with its sixteen pivot distances."""
    distinct = fps.groupBy("fp").agg(F.min("id").alias("first_id"))
    return distinct.select("fp", "first_id", _packed(F.col("fp"), PIVOTS[:8]).alias("near"), _packed(F.col("fp"), PIVOTS[8:]).alias("far"))


class _Forest:
    """Union-find over the rows of a block; parents have the smaller fingerprint."""

    def __init__(self, fp: np.ndarray) -> None:
        self.fp, self.parent = fp, np.arange(len(fp))

    def _settle(self) -> None:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Each round hangs roots under smaller ones; of several claims on a root one wins, the others meet in the next round."""
        while True:
            self._settle()
            a, b = self.parent[left], self.parent[right]
            apart = a != b
            if not apart.any():
                return
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            ordered = self.fp[a] < self.fp[b]
            self.parent[np.where(ordered, b, a)] = np.where(ordered, a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.flatnonzero(self.parent != np.arange(len(self.fp)))
        return self.fp[nodes], self.fp[self.parent[nodes]]


def _verified(fp: np.ndarray, coords: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers that pass the largest coordinate difference and then the exact distance."""
    kept = np.abs(coords[left] - coords[right]).max(axis=1, initial=0) <= radius
    left, right = left[kept], right[kept]
    close = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= radius
    return left[close], right[close]


def links(cell: np.ndarray, fp: np.ndarray, near: np.ndarray, far: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each run of equal `cell` numbers."""
    coords = np.column_stack([near.view(np.uint8).reshape(-1, 8), far.view(np.uint8).reshape(-1, 8)]).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.array([], np.int64)
    sizes = np.diff(np.r_[starts, len(cell)])
    forest = _Forest(fp)
    ends = np.repeat(starts + sizes, sizes)
    rows = np.flatnonzero(np.repeat(sizes <= SMALL_RUN, sizes))
    for step in range(1, SMALL_RUN):
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            break
        forest.link(*_verified(fp, coords, rows, rows + step, radius))
    for start, size in zip(starts[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist(), strict=True):
        order = start + np.argsort(coords[start:start + size, 0], kind="stable")
        first = coords[order, 0].astype(np.int64)
        stop = np.searchsorted(first, first + radius, side="right")
        for a in range(0, size, 128):
            b = min(a + 128, size)
            left, right = np.nonzero(np.arange(a, int(stop[b - 1]))[None, :] > np.arange(a, b)[:, None])
            inside = a + right < stop[a + left]
            forest.link(*_verified(fp, coords, order[a + left[inside]], order[a + right[inside]], radius))
    return forest.edges()


def _forests(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; the last cell of a batch waits for the next batch."""

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        change = np.any([c[1:] != c[:-1] for c in rows[:4]], axis=0) if len(rows[0]) else np.array([], bool)
        cell = np.r_[0, np.cumsum(change)] if len(rows[0]) else np.array([], np.int64)
        a, b = links(cell, *rows[4:], radius=radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    waiting: list[np.ndarray] | None = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        rows = [np.concatenate(pair) for pair in zip(waiting, rows, strict=True)] if waiting else rows
        if not len(rows[0]):
            continue
        other = np.flatnonzero(np.any([c != c[-1] for c in rows[:4]], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        waiting = [c[cut:] for c in rows]
        if cut:
            yield out([c[:cut] for c in rows])
    if waiting:
        yield out(waiting)


def linked(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges that connect the same fingerprints as all links do. `fps` is a stored pivot table."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for t, m in enumerate(MASKS)]))
    rows = fps.select("fp", "near", "far", keys.alias("k")).select("k.t", "k.bits", "fp", "near", "far")
    crowded = stored(rows.groupBy("t", "bits").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # In a bucket of several chunks each pair of different chunks is a cell; that also compares each chunk with itself.
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.array_except(F.sequence(F.lit(0), F.col("chunks") - 1), F.array("own"))
    )
    cells = (
        rows.join(crowded, ["t", "bits"]).withColumn("chunks", chunks).withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select("t", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "near", "far")
    )
    parts = cells.repartition("t", "bits", "low", "high").sortWithinPartitions("t", "bits", "low", "high")
    return parts.mapInArrow(partial(_forests, radius=radius), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = RADIUS,
                    chunk: int = CHUNK) -> DataFrame:
    """id, digest, fp, root, component_id: one row per row of `docs`. root is a fingerprint that names the component,
    component_id the smallest id in it. `radius` is 3 at most, as the block pairs cover no more."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3")
    rows = stored(fingerprints(docs, key, text, size), "fingerprints")
    fps = stored(pivot_table(rows), "pivots")
    stars = components(linked(fps, radius, chunk)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = stored(fps.select("fp", "first_id").join(stars, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    named = stored(rooted.select("fp", "root").join(smallest, "root"), "named")
    return rows.join(named, "fp").select("id", "digest", "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row of each component: that of its smallest id; of several rows with this id the one with the smallest text hash,
    of equal ones the first by its other columns. Columns and texts are as in `docs`."""
    return one_of_each(near_duplicates(docs, key, text, **options), docs, key, text)


def one_of_each(found: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The row of `docs` that stays of each component; `found` has id, digest, root, component_id."""
    first = found.filter(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = stored(first.groupBy("root", "id").agg(F.min("digest").alias("digest")), "chosen")
    there = chosen.select(
        F.col("id").isNull().alias(ROW[0]), F.coalesce("id", F.lit(-(1 << 63))).alias(ROW[1]), F.col("digest").alias(ROW[2])
    )
    rest = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text]))
    kept = docs.select(*docs.columns, *row_key(key, text)).join(there, list(ROW), "left_semi")
    one = Window.partitionBy(*ROW).orderBy(rest)
    return kept.withColumn("__row", F.row_number().over(one)).filter("__row = 1").select(*docs.columns)
