"""Shards by vector bin packing of groups of equal texts; bytes, tokens and rows are balanced jointly.

A group's demand is its share of all bytes, tokens and rows. Groups above an average lot are placed one by one; the others are
bundled by their digest into `LOTS` lots, so what is placed is a table whose size depends on parameters alone, at most
LOTS * (1 + 3 * PARTS) units however large the input. Units are placed in descending order, each on the shard where the
dot product of its demand with the residual capacity is highest. A group stays whole unless it holds more bytes than a
shard may; then it is dealt by row over as many parts as that takes. `bytes` is the law that the result obeys, so its
dimension weighs most.

Slots are numbered from each unit's first slot, so no task sorts a shard.

Defined cases: a null text is empty and groups with other empty texts; repeated rows have a slot each; an empty table gives an empty
result. Digests are 64 bits: texts that share one share a group, which changes nothing but their place.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import stored, text_of, words_of

LOTS, PARTS, ROW_BYTES = 4096, 16, 16
#: Parts that a group of one shard's bytes is dealt into; small ones level what whole groups leave uneven.
DEAL = 32
#: Of bytes, tokens and rows in the dot product.
WEIGHTS = (8.0, 1.0, 1.0)
UNIT = ["heavy", "unit", "piece", "part"]


def place(demands: np.ndarray, shards: int, weights: Iterable[float] = WEIGHTS) -> np.ndarray:
    """Shard of each row of `demands` (a row per unit, a column per dimension, each column a share of 1).

    Capacity is 1 / shards in each dimension. A shard that lacks room for a unit's bytes is taken only if all do.
    """
    scale = np.sqrt(np.fromiter(weights, float))
    residual = np.full((shards, demands.shape[1]), 1.0 / shards) * scale
    chosen = np.zeros(len(demands), np.int64)
    for i in np.argsort(-demands[:, 0], kind="stable"):
        unit = demands[i] * scale
        score = residual @ unit
        fits = residual[:, 0] >= unit[0]
        chosen[i] = at = int(np.where(fits, score, score - 1e6).argmax())
        residual[at] -= unit
    return chosen


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = text_of(text)
    return docs.select(
        F.col(key).cast("long").alias("id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.size(words_of(body)).cast("long").alias("tokens"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("digest"),
    )


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", lots: int = LOTS) -> DataFrame:
    """id, size, tokens, text_crc32, digest, shard, slot: one row per row of `docs`, slots gapless from 0 in each shard."""
    spark = docs.sparkSession
    rows = stored(measured(docs, key, text), "measured")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # At most `lots` groups are above the average lot in each dimension.
    above = " or ".join(f"{c} > {total[c]} / {lots}" for c in ("size", "tokens", "rows") if total[c])
    heavy = rows.groupBy("digest").agg(*sums).filter(above).select(
        "digest", F.when(F.col("size") > total["size"] / shards, F.ceil(F.col("size") * shards * DEAL / total["size"])).otherwise(1).cast("int").alias("pieces")
    ).collect()
    pieces = spark.createDataFrame([(r.digest, r.pieces) for r in heavy], "digest long, pieces int")
    by_row = F.xxhash64("id", F.lit("deal"))
    units = rows.join(F.broadcast(pieces), "digest", "left").select(
        "*", F.col("pieces").isNotNull().alias("heavy"),
        F.when(F.col("pieces").isNull(), F.pmod("digest", F.lit(lots))).otherwise(F.col("digest")).alias("unit"),
        F.when(F.col("pieces") > 1, F.pmod(by_row, F.col("pieces"))).otherwise(0).cast("int").alias("piece"),
        # Parts spread the numbering of a heavy group's rows; they stay on one shard.
        F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(PARTS))).otherwise(0).cast("int").alias("part"),
    )
    table = units.groupBy(*UNIT).agg(*sums).orderBy(*UNIT).toPandas()
    whole = table.groupby(UNIT[:3], sort=True, as_index=False)[["size", "tokens", "rows"]].sum()
    demands = whole[["size", "tokens", "rows"]].to_numpy(float) / [max(1, total[c]) for c in ("size", "tokens", "rows")]
    whole["shard"] = place(demands, shards)
    table = table.merge(whole[[*UNIT[:3], "shard"]], on=UNIT[:3]).sort_values(["shard", *UNIT], ignore_index=True)
    table["first"] = table.groupby("shard")["rows"].cumsum() - table["rows"]
    places = spark.createDataFrame(
        table[[*UNIT, "shard", "first"]], "heavy boolean, unit long, piece int, part int, shard int, first long"
    )
    order = Window.partitionBy(*UNIT).orderBy("id", "digest", "size", "text_crc32")
    numbered = units.withColumn("rank", F.row_number().over(order))
    return numbered.join(F.broadcast(places), UNIT).select(
        "id", "size", "tokens", "text_crc32", "digest", "shard", (F.col("first") + F.col("rank") - 1).alias("slot")
    )
