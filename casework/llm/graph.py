"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b: every node but the smallest of its component, with that smallest node.

    `edges` has longs a and b. Each round points the larger neighbours of a node at its smallest neighbour, then all neighbours of a node
    at the smallest of them; the number of edges never grows and rounds grow with the logarithm of the longest path. Minima are partial aggregates and stored
    tables, so both sides of the joins are plain shuffles and adaptive execution splits the edges of a hub.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    before, now = None, _state(edges)
    while now != before:
        low = stored(edges.groupBy("a").agg(F.min("b").alias("low")), "lows").withColumnRenamed("a", "b")
        large = stored(edges.join(low, "b", "left").select("a", F.coalesce("low", "b").alias("b")).distinct(), "large")
        small = large.withColumn("low", F.min("b").over(Window.partitionBy("a")))
        both = F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        edges = stored(small.select(both.alias("e")).select("e.a", "e.b").filter("a > b").distinct(), "edges")
        before, now = now, _state(edges)
    return edges
