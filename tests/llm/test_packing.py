"""Tokens against the tokenizer on whole texts, packing against the rule stated naively, and the result's laws."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casework.llm import packing, queries

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(texts: list[str]) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [e.ids + [0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def ids_of(text: str) -> list[int]:
    return np.frombuffer(packing.WordTokens(VOCABULARY).ids(text), "<u4").tolist()


def test_word_tokens_equal_whole_texts():
    draw = random.Random(1)
    pieces = ["the", "Don't", "we'll", "'s", "é", "É", "ß", "İ", "K", "ﬁ", "日本", "١٢", "3.14", ".,", "!?", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "\x0b", "\x0c",
              "\x1c", "\x85", "\xa0", " ", "　", " ", "\n", "\t", "-", "x", "X", "_", "🙂", "ͅ", "ạ̇", "²", "Ⅷ", "\x00", "Σς", "."]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 12))) for _ in range(5000)]
    tokens = packing.WordTokens(VOCABULARY)
    for text, want in zip(texts, whole_ids(texts), strict=True):
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == want, repr(text)


def test_added_tokens_are_one_id_each():
    assert ids_of("a <|endoftext|> b") == [320, 49407, 321, 0]
    assert ids_of("a<|endoftext|>b<|startoftext|>") == [320, 49407, 321, 49406, 0]
    assert ids_of("<|ENDOFTEXT|>") == [27, 347, 40786, 4160, 91, 285, 0]


def test_tokens_equal_on_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    tokens = packing.WordTokens(VOCABULARY)
    assert [np.frombuffer(tokens.ids(t), "<u4").tolist() for t in texts] == whole_ids(texts)


def naive(lengths: list[int], limit: int) -> list[tuple[int, int]]:
    """Tries every place and recomputes the whole sum."""
    bins: list[int] = []
    placed = []
    for s in lengths:
        best = None
        for gap in sorted({limit - b for b in bins if limit - b >= s} | {limit}):
            after = bins + [s] if gap == limit else [b + s if i == bins.index(limit - gap) else b for i, b in enumerate(bins)]
            gaps = [limit - b for b in after if b < limit]
            score = sum(gaps.count(g) ** 2 for g in set(gaps))
            if best is None or score < best[0]:
                best = (score, gap)
        placed.append(best[1])
        gap = best[1]
        if gap == limit:
            bins.append(s)
        else:
            bins[bins.index(limit - gap)] += s
    return placed


def test_sum_of_squares_rule():
    draw = random.Random(2)
    for _ in range(60):
        limit = draw.randint(3, 12)
        lengths = [draw.randint(1, limit) for _ in range(draw.randint(0, 40))]
        sequence, offset = packing.sum_of_squares(np.array(lengths, np.int64), limit)
        assert [limit - o for o in offset.tolist()] == naive(lengths, limit)
        fill: dict[int, int] = {}
        for s, q, o in zip(lengths, sequence.tolist(), offset.tolist(), strict=True):
            assert fill.get(q, 0) == o
            fill[q] = o + s
        assert all(f <= limit for f in fill.values())


def check_laws(rows: list, texts: list[tuple]) -> None:
    pieces = []
    for key, text in texts:
        ids = ids_of(text or "")
        pieces += [(key, p, a, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 2048)) for c in [ids[a:a + 2048]]]
    by = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(by, pieces)) == sorted(by(tuple(r)[:5]) for r in rows)
    fill: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(fill.values()) // 2048) * 1.02 + 1


def test_query_laws(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_laws(queries.op8(spark, SMALL).collect(), texts)


def test_odd_rows_and_sequences(spark):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x " * 5000), (4, "a " * 2047), (5, "word" * 20_000)]
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, sequence_id string")
    pieces = packing.token_pieces(docs, VOCABULARY, with_ids=True)
    placed = packing.pack(pieces)
    check_laws(placed.collect(), texts)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(pieces, placed).collect()}
    ids = {t[0]: ids_of(t[1] or "") for t in texts}
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == ids[r.id][r.start:r.start + r.length]
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_equal_rows_without_id_spread_over_packs(spark):
    pieces = spark.range(100_000).selectExpr("CAST(null AS BIGINT) AS id", "0 AS piece", "0L AS start", "700L AS length", "5L AS ids_crc32")
    placed = packing.pack(pieces, per_pack=10_000)
    sizes = [r["count"] for r in placed.groupBy((F.col("sequence_id") / (1 << 32)).cast("int")).count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 100_000 and max(sizes) < 12_000
