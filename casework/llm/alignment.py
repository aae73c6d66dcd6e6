"""Alignment of two tokenizers over the same bytes: groups between common ends, links inside them, corpus counts of linked id pairs.

Both encodings of a text are partitions of the same bytes. A dictionary leads from the end of a token to its place; the ends that both encodings
have, in order, cut both id lists into groups, and inside a group every pair of tokens whose byte ranges overlap is a link.

Counts of id pairs are over the whole corpus and come back to every document, which would be a join of all links. Instead documents are gathered in
chunks of about `CHUNK` pairs: a chunk keeps one list of its different pairs and its documents point into it. The lists, cut into `BUCKETS` parts by the B id, are
counted part by part and go back to their chunks, so a pair that stands in every text is as many entries as there are chunks. Lists and documents are rows of
bounded size and stay arrays on the way: no task holds more than a chunk or a part of the lists, and no pair is a row. The chunks are written once; nothing
is tokenised again, and a lost executor costs a re-read.

Defined cases: null and empty texts, and texts whose tokens do not join to the space and the text (unknown or normalised characters), have no tokens: zeros and an
empty digest. Such rows stay; repeated rows and rows without an id each have a row. A text is encoded whole, however long. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import stored, text_of

CHUNK = 1 << 20
BUCKETS = 1 << 11
#: Fixed value: the split into words that byte-level vocabularies of this kind were made with.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNKS = (
    "chunk long, bucket int, id long, n_a long, n_b long, n_groups long, n_links long, digest string, pairs array<long>, totals array<long>, "
    "places array<int>, counts array<int>"
)
COUNTED = "chunk long, places array<int>, n array<long>, best array<boolean>"
ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_CHUNK_TYPE = pa.schema([
    ("chunk", pa.int64()), ("bucket", pa.int32()), *[(n, pa.int64()) for n in ("id", "n_a", "n_b", "n_groups", "n_links")], ("digest", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
])


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the others follow from 256 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def in_merge_order(byte_level: str) -> bool:
    """Whether a vocabulary of the tokenizers library is plain byte-level merging by ascending ids after the usual split into words: then tiktoken
    gives the same ids from the same vocabulary, several times as fast."""
    with open(byte_level, encoding="utf-8") as file:
        told = json.load(file)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or told.get("normalizer") or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return False
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return all(x < y for x, y in zip(made, made[1:]))


class Encoders:
    """Ids and bytes of both tokenizers."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        a.encode_special_tokens = True
        letter, size = byte_letters(), a.get_vocab_size()
        names = [a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(map(letter.__getitem__, n)) if all(c in letter for c in n) else n.encode() for n in names]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.length_a, self.length_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.merges, self.names = in_merge_order(byte_level), list(map(str, range(max(size, len(self.bytes_b)))))
        if self.merges:
            import tiktoken

            special = a.get_added_tokens_decoder()
            ranks = {x: i for i, x in enumerate(self.bytes_a) if i not in special}
            self.encode_a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
            self.encode_a = partial(self.encode_a, disallowed_special=())
        else:
            self.encode_a = lambda text: a.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or nothing where either does not keep the bytes."""
        if not text:
            return None
        data, a, b = b" " + text.encode(), self.encode_a(" " + text), self.b.encode(text, num_threads=1)
        # Merging by ascending ids starts from single bytes and cannot lose one.
        if b"".join(map(self.bytes_b.__getitem__, b)) != data or not self.merges and b"".join(map(self.bytes_a.__getitem__, a)) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(maxsize=1)
def _worker_encoders(byte_level: str, pieces: str) -> Encoders:
    """Kept by a Python worker over its tasks."""
    return Encoders(byte_level, pieces)


def groups_of(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists at which groups end, exclusive: the dictionary of one side's ends is probed with the other's, which come in order."""
    at_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    found = np.fromiter(map(at_b.get, ends_a, repeat(0)), np.int64, len(ends_a))
    return np.flatnonzero(found) + 1, found[found > 0]


def links_of(ids_a: list[int], ids_b: list[int], ends_a: list[int], ends_b: list[int]) -> list[int]:
    """Pairs of overlapping tokens of one group, all but the last."""
    out, i, j = [], 0, 0
    while i < len(ids_a) and j < len(ids_b):
        out.append(ids_a[i] << 32 | ids_b[j])
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
    return out[:-1]


class _Said(dict):
    """Text of a group of one token each, by its pair of ids; starts anew when it is full."""

    def __missing__(self, pair: int) -> str:
        if len(self) >= 1 << 17:
            self.clear()
        said = self[pair] = f"{pair >> 32}|{pair & 0xFFFFFFFF}"
        return said


_SAID = _Said()


def aligned(encoders: Encoders, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups, n_links, digest of the groups, the different linked id pairs (A id in the upper 32 bits) and how often each is linked."""
    found = encoders.ids(text)
    if found is None:
        return 0, 0, 0, 0, "", np.array([], np.int64), np.array([], np.int64)
    a, b = found
    ends_a, ends_b = np.cumsum(encoders.length_a[a]).tolist(), np.cumsum(encoders.length_b[b]).tolist()
    to_a, to_b = groups_of(ends_a, ends_b)
    # The last tokens of a group always overlap. Most groups have no others; the rest are expanded slice by slice.
    linked = a[to_a - 1] << 32 | b[to_b - 1]
    said, others, name = list(map(_SAID.__getitem__, linked.tolist())), [], encoders.names.__getitem__
    from_a, from_b = np.r_[0, to_a[:-1]], np.r_[0, to_b[:-1]]
    more = np.flatnonzero((to_a - from_a > 1) | (to_b - from_b > 1))
    ids_a, ids_b = a.tolist(), b.tolist()
    for k, i, p, j, q in zip(*(x.tolist() for x in (more, from_a[more], to_a[more], from_b[more], to_b[more])), strict=True):
        x, y = ids_a[i:p], ids_b[j:q]
        said[k] = f"{','.join(map(name, x))}|{','.join(map(name, y))}"
        if q - j == 1:
            others += [v << 32 | y[0] for v in x[:-1]]
        elif p - i == 1:
            first = x[0] << 32
            others += [first | v for v in y[:-1]]
        else:
            others += links_of(x, y, ends_a[i:p], ends_b[j:q])
    linked = np.concatenate([linked, np.array(others, np.int64)])
    digest = hashlib.sha256(";".join(said).encode()).hexdigest()
    return len(a), len(b), len(said), len(linked), digest, *np.unique(linked, return_counts=True)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    return np.diff(column.combine_chunks().offsets.to_numpy())


def _bucket(pairs: np.ndarray) -> np.ndarray:
    """The part of a pair's B id: neighbouring ids, which are often alike in use, are dealt apart."""
    return ((pairs & 0xFFFFFFFF) % BUCKETS).astype(np.int32)


class _Chunk:
    """Documents that share one list of pairs."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.entries = 0

    def add(self, id_: int | None, facts: tuple, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append((id_, *facts))
        self.pairs.append(pairs)
        self.counts.append(counts.astype(np.int32))
        self.entries += len(pairs) + 1

    def _batch(self, number: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
        given = {"chunk": pa.array(np.full(rows, number, np.int64))} | columns
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(rows, f.type)) for f in _CHUNK_TYPE], schema=_CHUNK_TYPE)

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        """The documents, a row each, and the parts of the list."""
        counts, sizes = np.concatenate(self.counts), np.array([len(p) for p in self.pairs])
        pairs, places = np.unique(np.concatenate(self.pairs), return_inverse=True)
        names = ("id", "n_a", "n_b", "n_groups", "n_links", "digest")
        facts = {n: pa.array(x, _CHUNK_TYPE.field(n).type) for n, x in zip(names, zip(*self.docs, strict=True), strict=True)}
        yield self._batch(number, len(sizes), **facts, places=_lists(places.astype(np.int32), sizes), counts=_lists(counts, sizes))
        if len(pairs):
            totals = np.zeros(len(pairs), np.int64)
            np.add.at(totals, places, counts)
            part = _bucket(pairs)
            order = np.argsort(part, kind="stable").astype(np.int32)
            buckets, sizes = np.unique(part, return_counts=True)
            lists = {"pairs": pairs[order], "totals": totals[order], "places": order}
            yield self._batch(number, len(buckets), bucket=pa.array(buckets), **{n: _lists(x, sizes) for n, x in lists.items()})


def chunked(docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Encoded documents in chunks. Chunk numbers are unique in one run only, so the frame has to be stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, task = _worker_encoders(byte_level, pieces), TaskContext.get()
        number, open_ = (task.partitionId() if task else 0) << 32, _Chunk()
        for batch in batches:
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                *facts, pairs, counts = aligned(encoders, value.as_py())
                open_.add(id_, tuple(facts), pairs, counts)
                if open_.entries >= chunk:
                    yield from open_.batches(number)
                    number, open_ = number + 1, _Chunk()
        if open_.docs:
            yield from open_.batches(number)

    return docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("text")).mapInArrow(run, CHUNKS)


def _counted(part: pa.Table) -> pa.Table:
    """Of a part of all lists: links of each id pair in the corpus, and whether no pair of its B id has more. All pairs of a B id are in one part."""
    pairs, own = np.unique(_flat(part["pairs"]), return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, own, _flat(part["totals"]))
    ids, of = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
    most = np.zeros(len(ids), np.int64)
    np.maximum.at(most, of, n)
    best, sizes = n == most[of], _sizes(part["pairs"])
    columns = [part["chunk"].combine_chunks(), part["places"].combine_chunks(), _lists(n[own], sizes), _lists(best[own], sizes)]
    return pa.Table.from_arrays(columns, [f.split()[0] for f in COUNTED.split(", ")])


def _sums(lists: pa.Table, docs: pa.Table) -> pa.Table:
    """Sums of each document of a chunk over its pairs."""
    place = _flat(lists["places"])
    number, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    number[place], best[place] = _flat(lists["n"]), _flat(lists["best"])
    at, times = _flat(docs["places"]), _flat(docs["counts"]).astype(np.int64)
    edges = np.r_[0, np.cumsum(_sizes(docs["places"]))]
    sums = []
    for x in (best, number):
        total = np.r_[0, np.cumsum(x[at] * times)]
        sums.append(pa.array(total[edges[1:]] - total[edges[:-1]]))
    kept = [docs[n].combine_chunks() for n in ("id", "n_a", "n_b", "n_groups", "n_links", "digest")]
    return pa.Table.from_arrays([*kept[:-1], *sums, kept[-1]], [f.split()[0] for f in ALIGNED.split(", ")])


def align(docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per row. `byte_level` is a vocabulary of the tokenizers library whose
    tokens are spelled bytes (A), `pieces` a sentencepiece model with byte fallback (B)."""
    chunks = stored(chunked(docs, byte_level, pieces, key, text, chunk), "aligned")
    lists = chunks.where("bucket is not null").select("bucket", "chunk", "pairs", "totals", "places")
    counted = lists.groupBy("bucket").applyInArrow(_counted, COUNTED)
    told = chunks.where("bucket is null").drop("bucket", "pairs", "totals")
    return counted.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_sums, ALIGNED)
