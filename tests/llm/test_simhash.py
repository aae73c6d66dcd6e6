"""Fingerprints, links and components against all-pairs brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from casework.llm import graph, queries, simhash

SMALL = "/root/testdata/sf0.01"


def plain_fingerprint(text: str | None) -> int:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: list[int], radius: int = 3) -> dict[int, int]:
    """Fingerprint to the smallest fingerprint reachable."""
    values = np.array(sorted(set(fps)), np.uint64)
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= radius) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    return {int(v): int(values[root(i)]) for i, v in enumerate(values)}


def test_fingerprints_equal_plain_ones():
    texts = ["", " \n", "One", "one TWO", "A b  c", "É x\x0by z\x0c w", "a\xa0b c d", "x " * 5000 + "y", None]
    draw = random.Random(1)
    texts += [" ".join(draw.choice("ab cd ef gh Ij".split()) for _ in range(draw.randint(0, 40))) for _ in range(50)]
    for text in texts:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text), text


def test_blocks_of_a_long_text_make_the_same_fingerprint():
    draw = random.Random(2)
    text = " ".join(str(draw.randint(0, 10 ** draw.randint(1, 9))) for _ in range(400_000))
    assert len(text) > 2 << 20 and simhash.fingerprint(text) == plain_fingerprint(text)


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op2(spark, SMALL).collect()}
    fps = {k: plain_fingerprint(t) for k, t in docs.items()}
    roots = plain_components(list(fps.values()))
    smallest: dict[int, int] = {}
    for key, fp in fps.items():
        smallest[roots[fp]] = min(key, smallest.get(roots[fp], key))
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{fps[k]:016x}", smallest[roots[fps[k]]]) for k in docs}
    assert len(set(smallest.values())) < len(docs)


@pytest.mark.parametrize("chunk", [4096, 40])
def test_hot_buckets_lose_no_link(spark, chunk):
    """Many fingerprints around few centres: large buckets, with and without chunks, and far ones that must stay apart."""
    draw = random.Random(3)
    fps = set()
    for centre in [draw.getrandbits(64) for _ in range(4)]:
        fps |= {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for _ in range(250)}
    fps |= {draw.getrandbits(64) for _ in range(500)}
    rows = spark.createDataFrame([(simhash._signed(f), simhash._signed(f)) for f in fps], "fp long, id long")
    table = simhash.pivot_table(rows)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.linked(table, chunk=chunk).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges)
    found = {f: f for f in fps}

    def root(x: int) -> int:
        while found[x] != x:
            x = found[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        found[b] = a
    want = plain_components(list(fps))
    groups = lambda of: sorted(sorted(f for f in fps if of(f) == r) for r in {of(f) for f in fps})
    assert groups(root) == groups(want.get)


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 300)]
    star = [(1, i) for i in range(500, 900)]
    loops = [(7, 7), (900, 5000), (5000, 901), (901, 900)]
    edges = spark.createDataFrame([(b, a) if (a + b) % 3 else (a, b) for a, b in path + star + loops], "a long, b long")
    got = {r.a: r.b for r in graph.components(edges).collect()}
    assert got == {i: 100 for i in range(101, 301)} | {i: 1 for i in range(500, 900)} | {901: 900, 5000: 900}
    assert graph.components(edges.limit(0)).count() == 0


def test_odd_rows_and_deduplication(spark):
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(600)]
    text, long = " ".join(words[:300]), " ".join(words * 500)
    rows = [(4, text, "a"), (3, text, "b"), (3, text, "a"), (3, text.upper(), "c"), (None, text, "n"), (7, None, "x"), (6, "", "y"), (6, " ", "z"),
            (None, words[0], "p"), (None, words[0], "q"), (9, long, "l")]
    docs = spark.createDataFrame([(*r, r[2]) for r in rows], "doc_id long, text string, component_id string, fp string")
    found = sorted(((r.id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert found == sorted([(4, 3), (3, 3), (3, 3), (3, 3), (None, 3), (7, 6), (6, 6), (6, 6), (None, None), (None, None), (9, 9)], key=repr)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(map(str, [r.doc_id for r in kept.collect()]))
    assert ids == ["3", "6", "9", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.deduplicate(docs.limit(0)).count() == 0
