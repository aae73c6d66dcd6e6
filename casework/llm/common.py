"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.session import ensure_checkpoint_dir

#: ASCII white space; words are the runs of anything else.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, read by any number of later plans,
    and re-read, not recomputed, when an executor is lost."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text that is not null, in order, repeats included; no words: an empty array."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def span_list(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


#: Names of the three columns that tell the rows of a table apart; none of them is ever null.
ROW = ("__no_id", "__id", "__digest")


def row_key(key: str, text: str) -> list[Column]:
    """Whether the row has an id, the id, and a digest of the text, which parts rows that share an id."""
    number = F.col(key).cast("long")
    return [
        number.isNull().alias(ROW[0]), F.coalesce(number, F.lit(-(1 << 63))).alias(ROW[1]), F.xxhash64(text_of(text)).alias(ROW[2])
    ]


def row_id() -> Column:
    """The id of a row that `row_key` names."""
    return F.when(~F.col(ROW[0]), F.col(ROW[1]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body and lambdas inside it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
