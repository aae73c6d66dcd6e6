"""Text spans found by a Python function, row by row in Arrow batches, for the secret and personal-data scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS_DDL = "array<struct<kind: string, start: long, end: long>>"


def spans_of(docs: DataFrame, find: Callable[[str], list[Span]], key: str, text: str) -> DataFrame:
    """id, spans: what `find` returns for each row's whole text, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [] if not t.is_valid else [{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py())]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["id", "spans"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id long, spans {SPANS_DDL}"
    )


def replaced(docs: DataFrame, find: Callable[[str], list[Span]], text: str, mark: Callable[[str], str]) -> DataFrame:
    """The rows of `docs` with every span replaced by `mark(kind)`, overlapping spans by the first one's; other columns as they are."""
    at = docs.columns.index(text)

    def cut(value: str) -> str:
        parts, end = [], 0
        for kind, a, b in find(value):
            if a >= end:
                parts += [value[end:a], mark(kind)]
            end = max(end, b)
        return "".join([*parts, value[end:]]) if end else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([cut(t.as_py()) if t.is_valid else None for t in batch.column(at)], pa.string())
            yield batch.set_column(at, batch.schema.names[at], new)

    return docs.mapInArrow(run, docs.schema)
