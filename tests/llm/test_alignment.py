"""Alignment against a brute-force version that compares every pair of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from functools import cache

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, pre_tokenizers

from casework.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@cache
def plain_encoders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


@cache
def plain_letters() -> dict[str, int]:
    """Spelled letter of each byte, asked of the library."""
    spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    whole = {c.encode(): spell(c)[0][0] for c in map(chr, [*range(0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x110000, 1024)])}
    return {letter: byte for data, spelled in whole.items() for byte, letter in zip(data, spelled, strict=True)}


def plain_tokens(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(id, start, end) of both encodings, from their own decoders."""
    if not text:
        return [], []
    a, b = plain_encoders()
    letters, data, out = plain_letters(), b" " + text.encode(), []
    for ids, piece in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, tokens = 0, []
        for i in ids:
            tokens.append((i, at, at + len(piece(i))))
            at += len(piece(i))
        if b"".join(map(piece, ids)) != data:
            return [], []
        out.append(tokens)
    return out[0], out[1]


def plain_links(a: list, b: list) -> list[tuple[int, int]]:
    """Each byte's pair of tokens, every pair once."""
    owners = [[i for i, (_, s, e) in enumerate(side) for _ in range(s, e)] for side in (a, b)]
    return [(a[i][0], b[j][0]) for i, j in dict.fromkeys(zip(*owners, strict=True))]


def cut(tokens: list, ends: list[int]) -> list[list]:
    out, at = [], 0
    for end in ends:
        out.append([])
        while at < len(tokens) and tokens[at][2] <= end:
            out[-1].append(tokens[at])
            at += 1
    return out


def plain_rows(texts: list[tuple]) -> list[tuple]:
    docs, counts = [], Counter()
    for key, text in texts:
        a, b = plain_tokens(text)
        links = plain_links(a, b)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        inside = [[[str(x[0]) for x in part] for part in cut(side, ends)] for side in (a, b)]
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*inside, strict=True)]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        counts.update(links)
        docs.append((key, len(a), len(b), len(groups), links, digest))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (key, n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest)
        for key, n_a, n_b, n_groups, links, digest in docs
    ]


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(map(tuple, rows), key=repr)


def test_groups_and_links():
    ends_a, ends_b = [2, 3, 7, 9, 12], [1, 3, 5, 6, 8, 12]
    assert [x.tolist() for x in alignment.groups_of(ends_a, ends_b)] == [[2, 5], [2, 6]]
    a, b = list(range(5)), list(range(6))
    links = alignment.links_of(a[:2], b[:2], ends_a[:2], ends_b[:2]) + [1 << 32 | 1] + alignment.links_of(a[2:], b[2:], ends_a[2:], ends_b[2:]) + [4 << 32 | 5]
    spans = [list(zip([0, *e], e)) for e in (ends_a, ends_b)]
    assert [(x >> 32, x & 0xFFFFFFFF) for x in links] == [
        (i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]
    ]


def test_fast_ids_equal_the_library(monkeypatch):
    assert alignment.in_merge_order(A) and not alignment.in_merge_order(public_tokenizers.path("word_bpe_49k.json"))
    fast = alignment.Encoders(A, B)
    monkeypatch.setattr(alignment, "in_merge_order", lambda path: False)
    plain = alignment.Encoders(A, B)
    draw = random.Random(7)
    pieces = ["a", "Z", "é", "\n", " ", "  ", "\t", "'s", "'LL", "12", "½", "日", "🙂", "\u00a0", "\u2003", "<|endoftext|>", "-", "\x00", "ß", "\u0301", "word"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 30)))
        assert fast.encode_a(text).tolist() == plain.encode_a(text), repr(text)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "<s> </s> <unk> <|endoftext|> ▁"), (6, "naïve café 日本語 🙂\n\ttabs\x00"),
    (6, "naïve café 日本語 🙂\n\ttabs\x00"), (None, "the same text"), (7, "the same text"), (8, "ﬁ ½ Å é"), (9, "x" * 5000), (10, "<0x41>"),
]


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_rows_equal_brute_force(spark, chunk):
    draw = random.Random(5)
    words = ["the", "token", "isation", "ing", "é", "日本", "—", "\n", "  ", "😀", "123", "don't", "<s>", "Ω"]
    texts = ODD + [(100 + i, "".join(draw.choice(words) + draw.choice(["", " "]) for _ in range(draw.randint(1, 30)))) for i in range(60)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts], "doc_id long, text string, n_a string").repartition(5)
    got = alignment.align(docs, A, B, chunk=chunk).collect()
    assert in_order(got) == in_order(plain_rows(texts))
    assert sum(r.n_a == 0 for r in got) >= 3
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_query(spark):
    """Groups and sums of the query on all documents; links of a text by their ranges, as all pairs of a long text's tokens take too long."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_token_alignment"](spark, SMALL).collect()
    assert in_order(got) == in_order(plain_rows([tuple(r) for r in docs]))


def test_lists_and_documents_are_rows_of_bounded_size(spark, monkeypatch):
    """A chunk is not one row with all its pairs: documents are rows, and the list is dealt by its B ids."""
    draw = random.Random(9)
    docs = [(i, "".join(chr(draw.randint(97, 122)) + draw.choice(["", " "]) for _ in range(400))) for i in range(40)]
    rows = alignment.chunked(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), A, B).collect()
    assert len({r["chunk"] for r in rows}) == 1 and sorted(r["id"] for r in rows if r["bucket"] is None) == list(range(40))
    lists = [r for r in rows if r["bucket"] is not None]
    pairs = [p for r in lists for p in r["pairs"]]
    assert len(pairs) == len(set(pairs)) > 500 and sorted(p for r in lists for p in r["places"]) == list(range(len(pairs)))
    assert all({(p & 0xFFFFFFFF) % alignment.BUCKETS for p in r["pairs"]} == {r["bucket"]} for r in lists)
    assert max(len(r["pairs"]) for r in lists) < len(pairs) / 10
