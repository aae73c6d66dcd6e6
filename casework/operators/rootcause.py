"""Systemic clusters: J4-J6, D21, E4, F3, H33."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.session import cut_lineage

MIN_CLUSTER = 5
DOMINANT_SHARE = 0.60
CITY_SHARE = 0.40
MAX_CLUSTERS = 12
RESTARTS = 10
SEED = 42
TOP_CITIES = 3


def assign_clusters(vectors: DataFrame, k: int = MAX_CLUSTERS, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """KMeans labels for every vector; of the restarts, which run side by side, the one with the lowest cost wins.

    `k` is what it says, at any number of vectors; without vectors there are no labels.
    """
    usable = vectors.where(F.col("embedding").isNotNull())
    points = cut_lineage(usable.withColumn("features", array_to_vector("embedding")))
    if points.isEmpty():
        return usable.withColumn("cluster_id", F.lit(0))

    def fit(i: int):
        return KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster_id").fit(points)

    with ThreadPoolExecutor(restarts) as pool:
        best = min(pool.map(fit, range(restarts)), key=lambda m: m.summary.trainingCost)
    return best.transform(points).drop("features")


def profiles(labelled: DataFrame) -> DataFrame:
    """D21 + E4: size, modal category and city with their shares, top cities, number of cities.

    Rows are first counted per (cluster, category) and (cluster, city); the rest works on those counts.
    """
    def named(column: str):
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("Unknown")).alias("value")

    categories = labelled.groupBy("cluster_id", named("category")).agg(F.count("*").alias("n"))
    modal = categories.groupBy("cluster_id").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))).alias("top"),
        F.sum("n").alias("count"),
    )
    cities = labelled.groupBy("cluster_id", named("location")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "value"))
    leading = cities.withColumn("rank", rank).where(F.col("rank") <= TOP_CITIES)
    leaders = leading.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("value").alias("city"), "n"))).alias("leaders")
    )
    distinct = cities.groupBy("cluster_id").agg(F.count("*").alias("city_count"))
    return (
        modal.join(leaders, "cluster_id")
        .join(distinct, "cluster_id")
        .select(
            "cluster_id",
            "count",
            F.col("top.value").alias("category"),
            (-F.col("top.neg") / F.col("count")).alias("category_share"),
            F.col("leaders")[0]["city"].alias("top_city"),
            (F.col("leaders")[0]["n"] / F.col("count")).alias("city_share"),
            F.filter("leaders", lambda c: c["city"] != "Unknown").alias("top_cities"),
            "city_count",
        )
    )


def alerts(labelled: DataFrame) -> DataFrame:
    """J5 + H33 + F3: dominated clusters with their summary, largest first."""
    found = profiles(labelled).where(
        (F.col("count") >= MIN_CLUSTER) & (F.col("category_share") >= DOMINANT_SHARE)
    )
    n, kind = F.col("count").cast("string"), F.col("category")
    concentrated = F.col("city_share") >= CITY_SHARE
    named = F.aggregate("top_cities", F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    phrase = F.array_join(
        F.transform("top_cities", lambda c: F.concat(c["city"], F.lit(" ("), c["n"].cast("string"), F.lit(")"))), ", "
    )
    elsewhere = F.when(
        F.col("count") > named, F.concat(F.lit(" + "), (F.col("count") - named).cast("string"), F.lit(" elsewhere"))
    ).otherwise("")
    whole_percent = F.bround(F.col("city_share") * 100, 0).cast("long").cast("string")
    summary = (
        F.when(
            concentrated,
            F.concat(n, F.lit(" "), kind, F.lit(" complaints concentrated in "), "top_city", F.lit(" ("), whole_percent,
                     F.lit("% of cluster) -- possible local "), kind, F.lit(" service issue.")),
        )
        .when(
            F.size("top_cities") > 0,
            F.concat(n, F.lit(" "), kind, F.lit(" complaints across "), F.col("city_count").cast("string"),
                     F.lit(" cities. Top hotspots: "), phrase, elsewhere, F.lit(". Possible systemic "), kind,
                     F.lit(" issue.")),
        )
        .otherwise(
            F.concat(n, F.lit(" "), kind, F.lit(" complaints, location unknown -- possible systemic "), kind,
                     F.lit(" issue."))
        )
    )
    return found.select(
        "cluster_id",
        "category",
        F.when(concentrated, F.col("top_city")).alias("location"),
        "count",
        F.round("category_share", 2).alias("category_share"),
        F.round("city_share", 2).alias("location_share"),
        summary.alias("summary"),
    ).orderBy(F.col("count").desc(), F.col("category_share").desc(), "cluster_id")


def numbered(found: DataFrame, created_at) -> DataFrame:
    """Alerts as stored rows. At most one alert per cluster, so the window holds a dozen rows."""
    position = F.row_number().over(
        Window.orderBy(F.col("count").desc(), F.col("category_share").desc(), "cluster_id")
    )
    return found.select(
        position.cast("bigint").alias("id"), "cluster_id", "category", "location", "count", "summary",
        F.lit(str(created_at)).cast("timestamp_ntz").alias("created_at"),
    )


def detect(vectors: DataFrame, k: int = MAX_CLUSTERS, restarts: int = RESTARTS) -> DataFrame:
    """J4-J5 end to end; too few vectors make no cluster of `MIN_CLUSTER`, hence no alert."""
    # Clusters are stored; texts and other columns of a case would be stored with them.
    return alerts(assign_clusters(vectors.select("embedding", "category", "location"), k, restarts))
