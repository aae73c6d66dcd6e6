"""Text vectors whose document frequencies are fitted once, kept, and brought up to date by adding counts.

Words are hashed to `dims` buckets. `counts` says in how many texts each bucket stands; counts of several tables, days or triggers add up with `merged`.
A `TextVectoriser` made of them weighs a text's bucket counts by inverse document frequency and scales them to length one. As long as its version is the
same, vectors of different frames and triggers compare; a new version wants the stored vectors made anew.

Null and empty texts have the zero vector, which no duplicate search takes for a neighbour.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.models.stored import read_facts, write_facts

DIMS = 384
#: Bucket of the row that counts the texts themselves.
ALL = -1


def _buckets(text: Column, dims: int) -> Column:
    """Bucket of every word, repeats included."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))


def counts(df: DataFrame, text: str, dims: int = DIMS) -> DataFrame:
    """bucket, df: at most `dims` + 1 rows, added up before the shuffle."""
    seen = F.concat(F.array(F.lit(ALL)), F.array_distinct(_buckets(F.col(text), dims)))
    return df.select(F.explode(seen).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df"))


def merged(*parts: DataFrame) -> DataFrame:
    """Counts of several tables as one."""
    return reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.sum("df").alias("df"))


def _scorer(weights: tuple[float, ...]) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def unit(buckets: pd.Series) -> pd.Series:
        idf = np.asarray(weights)
        out = []
        for found in buckets:
            row = np.bincount(found, minlength=len(idf)) * idf
            length = np.linalg.norm(row)
            out.append((row / length if length else row).astype(np.float32))
        return pd.Series(out)

    return unit


@dataclass(frozen=True)
class TextVectoriser:
    """`frequencies[b]` texts of `texts` hold bucket b."""

    texts: int
    frequencies: tuple[int, ...]
    version: str = "1"

    @classmethod
    def of(cls, counted: DataFrame, version: str = "1", dims: int = DIMS) -> TextVectoriser:
        """From `counts`, whose number of rows has a bound."""
        found = {r["bucket"]: r["df"] for r in counted.collect()}
        return cls(found.get(ALL, 0), tuple(found.get(b, 0) for b in range(dims)), version)

    def __call__(self, text: Column) -> Column:
        """The embedding of a text column, as `start_mail_ingest(vectors=...)` takes it."""
        weights = tuple(float(np.log((1 + self.texts) / (1 + n)) + 1) for n in self.frequencies)
        return _scorer(weights)(_buckets(text, len(self.frequencies)))

    def save(self, spark: SparkSession, path: str) -> None:
        write_facts(spark, {"texts": self.texts, "frequencies": self.frequencies, "version": self.version}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextVectoriser:
        facts = read_facts(spark, path)
        return cls(facts["texts"], tuple(facts["frequencies"]), facts["version"])
