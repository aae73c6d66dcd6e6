"""Joining per-key values back to rows when one key may own a third of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The heaviest keys are broadcast, never more than this many. A key outside them owns less than 1/HOT_KEYS of
# the rows, whatever the data looks like.
HOT_KEYS = 1000


def attach_by_key(rows: DataFrame, per_key: DataFrame, key: str, weight: str, spread: str,
                  hot_keys: int = HOT_KEYS) -> DataFrame:
    """Left-join `per_key` (unique on `key`, `weight` = its number of rows) to `rows`, without `weight`.

    The `hot_keys` heaviest keys are joined by broadcast. Their rows, and rows with a null key, enter the
    remaining join under a digest of `spread` that matches nothing, so no shuffle partition is hot. Both sides
    of `per_key` have the same columns, so its shuffle is computed once and reused.
    """
    values = [c for c in per_key.columns if c not in (key, weight)]
    packed = per_key.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(weight).alias("_weight"), F.struct(*values).alias("_value")
    )
    hot = packed.orderBy(F.col("_weight").desc(), "_key").limit(hot_keys).select(
        F.col("_key").alias("_hot_key"), F.col("_value").alias("_hot_value")
    )
    cold = packed.select(
        F.concat(F.lit("k"), F.col("_key").cast("string")).alias("_cold_key"), F.col("_value").alias("_cold_value")
    )
    settled = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    seeded = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_join_key",
        F.when(settled, F.concat(F.lit("s"), F.xxhash64(spread).cast("string")))
        .otherwise(F.concat(F.lit("k"), F.col(key).cast("string"))),
    )
    joined = seeded.join(cold, F.col("_join_key") == F.col("_cold_key"), "left")
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[F.coalesce(F.col("_hot_value"), F.col("_cold_value"))[v].alias(v) for v in values],
    )
