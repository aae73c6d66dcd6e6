from __future__ import annotations

import random
import zlib
from collections import defaultdict

from casework.llm import queries, sharding

SMALL = "/root/testdata/sf0.01"


def check_laws(rows: list, texts: list[tuple], shards: int) -> dict[int, int]:
    want = sorted((k is None, k or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in texts)
    assert sorted((r[0] is None, r[0] or 0, r.size, r.text_crc32) for r in rows) == want
    slots, sizes = defaultdict(list), dict.fromkeys(range(shards), 0)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return sizes


def test_query_is_even_and_keeps_groups(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = queries.op6(spark, SMALL).collect()
    sizes = check_laws(rows, texts, 40)
    mean = sum(sizes.values()) / 40
    assert max(sizes.values()) <= 1.02 * mean and min(sizes.values()) >= 0.98 * mean
    groups = defaultdict(set)
    for r in rows:
        groups[r.group_digest].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.shard] += r.tokens
    assert max(tokens.values()) <= 1.25 * sum(tokens.values()) / 40


def test_hot_group_is_dealt_over_shards(spark):
    draw = random.Random(1)
    texts = [(i, "same text of a third") for i in range(3000)] + [(5000 + i, "x" * draw.randint(0, 30)) for i in range(6000)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), 10).collect()
    sizes = check_laws(rows, texts, 10)
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 10


def test_odd_rows(spark):
    texts = [(1, None), (1, None), (None, ""), (2, "é" * 100_000), (3, "a"), (3, "a")]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, shard string")
    rows = sharding.shard(docs, 3).collect()
    check_laws(rows, texts, 3)
    assert sharding.shard(docs.limit(0), 3).count() == 0
