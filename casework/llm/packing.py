"""Sum-of-squares packing of tokenised documents into sequences.

A document's ids are those of its text and one end id; documents longer than a sequence are cut into whole pieces and a rest.
Each piece goes where the sum over all gaps of (open sequences with this gap) squared becomes smallest: into an open sequence with some gap, or into a new one. Ties take the
smallest gap. Pieces are dealt by a digest over packs of about `PACK` pieces that are packed independently, the longest first; the digest takes
in the row's place in the stored table, so that repeated rows spread. A pack needs only lengths, so texts and ids never leave the task that tokenised them.

Defined cases: null and empty texts are the end id alone; texts are tokenised whole, in blocks; repeated rows are packed each; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from casework.llm.common import stored, text_of
from casework.llm.wordblocks import word_blocks

K = TypeVar("K", str, bytes)
LIMIT, PACK, END_ID = 2048, 16_384, 0
#: Words, and as many units, that a Python worker keeps, and the longest that it keeps: the bound of its memory.
CACHE_WORDS, CACHE_LENGTH = 1 << 20, 64

PIECES = "id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"
PIECES_NAMES = [field.split()[0] for field in PIECES.split(", ")]


#: Words of these characters fall into letters, single digits and runs of signs; the apostrophe has rules of its own and is not among them.
_PLAIN = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
_UNITS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class _Cache(dict):
    """A dictionary that computes what it lacks, and starts anew when it is full."""

    def __init__(self, compute: Callable[[K], bytes]) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, key: K) -> bytes:
        found = self.compute(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = found
        return found


class WordTokens:
    """Ids of words. The vocabulary drops white space before it merges, so a text's ids are those of its words in turn, and a word's
    those of its units: runs of letters, digits, runs of signs. Words and units repeat, so most are looked up. Words
    with other characters go to the tokenizer whole. Only works for vocabularies with this property.

    Added tokens of the vocabulary are one id each where a text spells them exactly; elsewhere, in other case too, they are plain characters."""

    def __init__(self, vocabulary: str) -> None:
        self.tokenizer = Tokenizer.from_file(vocabulary)
        # Words come here lower-cased and between added tokens, so what looks like one is none.
        self.tokenizer.encode_special_tokens = True
        self.added = {t.content: array("I", [i]).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytewise = {c: spell(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.units: _Cache = _Cache(self._unit)
        self.words: _Cache = _Cache(self._word)

    def _unit(self, unit: str) -> bytes:
        spelled = unit if unit.isascii() else unit.translate(self.bytewise)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        lower = text.lower()
        if len(word) <= CACHE_LENGTH and _PLAIN.fullmatch(lower) and len(lower) == len(text):
            return b"".join(map(self.units.__getitem__, _UNITS.findall(lower)))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of the text and the end id, as unsigned 32-bit integers."""
        segments = self.at_added.split(text) if self.at_added else [text]
        parts: list[bytes] = []
        for i, segment in enumerate(segments):
            if i % 2:
                parts.append(self.added[segment])
            else:
                parts += [b"".join(map(self.words.__getitem__, words)) for words in word_blocks(segment)]
        return b"".join([*parts, array("I", [END_ID]).tobytes()])


@lru_cache(maxsize=1)
def _worker_tokens(vocabulary: str) -> WordTokens:
    """Kept by a Python worker over its tasks."""
    return WordTokens(vocabulary)


def token_pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and with_ids the ids themselves (little-endian, unsigned, 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _worker_tokens(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for key_, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.ids(value.as_py())
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at:at + 4 * limit]
                    rows.append((key_, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns[: 5 + with_ids], names[: 5 + with_ids])

    plain = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("text"))
    return plain.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in the order given.

    open_[g] counts open sequences with gap g. Taking one with gap g for a length s changes the sum of squares by
    (1 - 2 * open_[g]) + (1 + 2 * open_[g - s]), where a filled sequence (gap 0) counts nothing; a new one is a sequence
    with gap `limit` that did not count before.
    """
    open_ = np.zeros(limit + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(limit + 1)]
    sequence, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        after = 1 + 2 * open_[: limit + 1 - s]
        after[0] = 0
        change = np.where(open_[s:] > 0, 1 - 2 * open_[s:], limit * len(lengths) + 1) + after
        change[limit - s] = after[limit - s]  # a new sequence
        gap = s + int(change.argmin())
        if gap == limit:
            at, used = used, used + 1
        else:
            at = waiting[gap].pop()
            open_[gap] -= 1
        sequence[i], offset[i] = at, limit - gap
        if gap > s:
            waiting[gap - s].append(at)
            open_[gap - s] += 1
    return sequence, offset


def pack(pieces: DataFrame, limit: int = LIMIT, per_pack: int = PACK) -> DataFrame:
    """`pieces` (a stored table) with sequence_id and offset."""
    packs = max(1, -(-pieces.count() // per_pack))
    row = F.monotonically_increasing_id()  # a stored table reads alike in every attempt
    dealt = pieces.select(*PIECES_NAMES, F.pmod(F.xxhash64("id", "piece", "ids_crc32", row), F.lit(packs)).alias("pack"))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        sequence, offset = sum_of_squares(group["length"].to_numpy(), limit)
        return group[PIECES_NAMES].assign(sequence_id=(int(group["pack"].iat[0]) << 32) + sequence, offset=offset)

    return dealt.groupBy("pack").applyInPandas(place, PLACED)


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = LIMIT, per_pack: int = PACK, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(token_pieces(docs, vocabulary, limit, key, text), "pieces"), limit, per_pack)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids, starts: the packed ids, from pieces with ids and their places. Pieces of repeated rows are equal, so any of them may stand for another."""
    ids = pieces.groupBy("id", "piece", "ids_crc32").agg(F.first("ids").alias("ids"))
    p, i = placed.alias("p"), ids.alias("i")
    same = F.col("p.id").eqNullSafe(F.col("i.id")) & (F.col("p.piece") == F.col("i.piece")) & (F.col("p.ids_crc32") == F.col("i.ids_crc32"))
    joined = p.join(i, same).select("p.sequence_id", "p.offset", "i.ids")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    grouped = joined.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["offset"]).alias("starts"),
    )
