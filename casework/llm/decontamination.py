r"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A document contains an item if it has `percent` of the item's distinct five-word shingles or more. Jaccard similarity says little here: a short
item inside a long document has a similarity near zero, and banded signatures would miss it. So each item is indexed by its smallest
min-hashes instead, and the documents are probed with all of theirs. Items are partitioned by size: in the class whose largest size is
u, an item's sketch holds its floor((100 - percent) * u / 100) + 1 smallest shingle hashes. A document that lacks all of them lacks more shingles
than containment allows, so no containing pair is missed. Documents with fewer shingles than an item needs
are not paired with it. The pairs found are verified with the shingles themselves.

The index is broadcast in blocks of at most `BLOCK` hashes, one probing pass per block. Documents travel only if they are in a
found pair.

Words are runs of letters and digits, lower-cased. Defined cases: null and empty texts hold nothing and an item without words is in no
document; an item of fewer words than a shingle is one shingle of its own width, and documents are probed with shingles of the widths that items have, so
it is found inside longer documents too; repeated rows give
a pair once, with the largest containment if texts differ; rows without an id pair as id null; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import ROW, let, row_id, row_key, stored, text_of

SHINGLE, PERCENT, BLOCK = 5, 80, 1_000_000


def _words(text: Column) -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles(text: Column, of: Callable[..., Column], widths: tuple[int, ...] = (SHINGLE,)) -> Column:
    """`of` applied to the words of each shingle of these widths, in order, repeats included."""

    def windows(words: Column, width: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - width)
        many = F.transform(starts, lambda i: of(*[F.get(words, i + k) for k in range(width)]))
        return F.when(F.size(words) >= width, many).otherwise(F.array())

    if not widths:
        return F.array()
    return F.coalesce(let(_words(text), lambda words: F.concat(*[windows(words, w) for w in widths])), F.array())


def item_shingles(text: Column, of: Callable[..., Column]) -> Column:
    """Those of an item: of `SHINGLE` words, or all its words as one."""
    short = F.coalesce(let(_words(text), lambda words: F.when(F.size(words).between(1, SHINGLE - 1), F.size(words))), F.lit(SHINGLE))
    branch = F.when(short == SHINGLE, shingles(text, of))
    for width in range(1, SHINGLE):
        branch = branch.when(short == width, shingles(text, of, (width,)))
    return branch


def item_widths(items: DataFrame, text: str = "text") -> tuple[int, ...]:
    """Widths of the items' shingles, at most `SHINGLE` numbers."""
    width = F.least(F.size(_words(text_of(text))), F.lit(SHINGLE))
    return tuple(sorted(r["w"] for r in items.select(width.alias("w")).distinct().collect() if r["w"] > 0))


def _hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def _joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def item_index(items: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """item_digest, need, hash: the sketch of each distinct item text, a row per hash."""
    hashed = items.select(
        F.xxhash64(text_of(text)).alias("item_digest"), F.array_distinct(item_shingles(text_of(text), _hash)).alias("hashes")
    ).distinct()
    size = F.size("hashes")
    largest = F.expr("shiftleft(1L, length(bin(size(hashes)))) - 1")  # of the size class
    sketch = F.slice(F.sort_array("hashes"), F.lit(1), F.floor((100 - percent) * largest / 100).cast("int") + 1)
    need = F.ceil(size * percent / 100).cast("int")
    return hashed.filter(size > 0).select("item_digest", need.alias("need"), F.explode(sketch).alias("hash"))


def candidates(docs: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK,
               widths: tuple[int, ...] = (SHINGLE,)) -> DataFrame:
    """Row key and item_digest of the pairs that share a sketched hash. `index` is a stored table."""
    passes = max(1, -(-index.count() // block))
    probes = docs.select(*row_key(key, text), shingles(text_of(text), _hash, widths).alias("hashes"))
    probes = probes.select(*ROW, F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    found = [
        probes.join(F.broadcast(index.filter(F.pmod("hash", F.lit(passes)) == i)), "hash").filter("n >= need")
        for i in range(passes)
    ]
    return reduce(DataFrame.union, found).select(*ROW, "item_digest").distinct()


def row_pairs(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
              item_text: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Row key, item, shared, item_shingles of all pairs with enough containment; repeated rows repeat theirs."""
    index = stored(item_index(items, item_text, percent), "sketches")
    widths = item_widths(items, item_text)
    pairs = candidates(docs, index, key, text, block, widths).groupBy(*ROW).agg(F.collect_list("item_digest").alias("pairs"))
    texts = docs.select(*row_key(key, text), text_of(text).alias("text")).join(stored(pairs, "candidates"), list(ROW))
    whole = texts.select(*ROW, "pairs", F.array_distinct(shingles(F.col("text"), _joined, widths)).alias("mine"))
    each = whole.select(*ROW, "mine", F.explode("pairs").alias("item_digest"))
    full = items.select(
        F.col(item_key).cast("long").alias("item"), F.xxhash64(text_of(item_text)).alias("item_digest"),
        F.array_distinct(item_shingles(text_of(item_text), _joined)).alias("theirs"),
    ).distinct()
    shared, size = F.size(F.array_intersect("mine", "theirs")), F.size("theirs")
    verified = each.join(full, "item_digest").select(*ROW, "item", shared.alias("shared"), size.alias("item_shingles"))
    return verified.filter(F.col("shared") * 100 >= F.col("item_shingles") * percent)


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """doc, item, shared, item_shingles, containment: each pair once."""
    rows = row_pairs(docs, items, key, text, **options).withColumn("doc", row_id())
    best = rows.groupBy("doc", "item").agg(F.max(F.struct(F.col("shared") / F.col("item_shingles"), "shared", "item_shingles")).alias("best"))
    return best.select(
        "doc", "item", F.col("best.shared").cast("long").alias("shared"), F.col("best.item_shingles").cast("long").alias("item_shingles"),
        (F.col("best.shared") / F.col("best.item_shingles")).alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The rows of `docs` that contain no item."""
    hit = stored(row_pairs(docs, items, key, text, **options).select(*ROW).distinct(), "contaminated")
    return docs.select(*docs.columns, *row_key(key, text)).join(hit, list(ROW), "left_anti").select(*docs.columns)
