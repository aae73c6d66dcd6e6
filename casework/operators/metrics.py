"""Evaluation metrics D22-D24 and drift K21, from (actual, predicted) columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """D23."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("rows"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """D22 counts."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("rows")
    )


def class_report(df: DataFrame, actual: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 per class of a closed vocabulary, zero where undefined, in one pass."""
    a, p = F.col(actual), F.col(predicted)
    wide = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("class"),
                    F.count_if((a == c) & (p == c)).alias("hits"),
                    F.count_if(p == c).alias("predicted"),
                    F.count_if(a == c).alias("support"),
                )
                for c in classes
            ]
        ).alias("rows")
    )
    long = wide.select(F.inline("rows"))
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.col("hits") * 2.0, F.col("predicted") + F.col("support")), F.lit(0.0))
    return long.select(
        "class",
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        "support",
    )


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """D22."""
    hit = F.count_if(F.col(actual) == F.col(predicted))
    return df.agg(F.count("*").alias("rows"), F.round(F.try_divide(hit, F.count("*")), 4).alias("accuracy"))


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute error and R2 in one pass. The variance aggregate is merged from partial moments."""
    error = F.col(actual) - F.col(predicted)
    return df.agg(
        F.round(F.avg(F.abs(error)), 3).alias("mae"),
        F.round(1 - F.try_divide(F.avg(error * error), F.var_pop(actual)), 4).alias("r2"),
    )


def drift(reference: DataFrame, current: DataFrame, groups: dict[str, Column], least_rows: int = 30) -> DataFrame:
    """Population stability index per grouped column, marked `too_small` where `current` has fewer than `least_rows` rows.

    `groups` maps a column name to a bucket expression with a bounded set of values.
    """
    def long(df: DataFrame, side: str) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(F.lit(n).alias("column"), F.coalesce(c.cast("string"), F.lit("(null)")).alias("bucket"))
                for n, c in groups.items()
            ]
        )
        return df.select(F.inline(pairs)).groupBy("column", "bucket").agg(F.count("*").alias(side))

    both = long(reference, "ref_rows").join(long(current, "cur_rows"), ["column", "bucket"], "full_outer")
    both = both.fillna(0, ["ref_rows", "cur_rows"])
    totals = both.groupBy("column").agg(F.sum("ref_rows").alias("ref_total"), F.sum("cur_rows").alias("cur_total"))
    share = both.join(totals, "column")
    floor = F.lit(0.0001)
    ref = F.greatest(F.try_divide("ref_rows", "ref_total"), floor)
    cur = F.greatest(F.try_divide("cur_rows", "cur_total"), floor)
    index = share.groupBy("column").agg(
        F.round(F.sum((cur - ref) * F.ln(cur / ref)), 4).alias("psi"), (F.max("cur_total") < least_rows).alias("too_small")
    )
    return index.withColumn("drifted", F.col("psi") > 0.2)


#: Size of a quantile sketch: ranks are off by about 0.1 % of the rows.
SKETCH = 4096


def quantile_sketches(df: DataFrame, columns: Sequence[str], size: int = SKETCH) -> DataFrame:
    """One row with a sketch per numeric column, null where there is no number. Sketches of days or partitions merge to that of all (`merged_sketches`)."""
    return df.agg(*[F.kll_sketch_agg_double(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(size)).alias(c) for c in columns])


def merged_sketches(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sketches of several rows as one."""
    return sketches.agg(*[F.kll_merge_agg_double(c).alias(c) for c in columns])


def quantile_edges(sketches: DataFrame, columns: Sequence[str], buckets: int = 10) -> dict[str, list[float]]:
    """Inner bucket edges per column, at most `buckets` - 1 numbers each; columns without numbers have none."""
    ranks = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    counted = [F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, ranks)).alias(c) for c in columns]
    row = sketches.select(*counted).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def numeric_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], buckets: int = 10, least_rows: int = 30,
                  size: int = SKETCH) -> DataFrame:
    """K21 on numbers: `drift` over buckets between the reference's quantiles, and `distance`, the largest gap at these edges between the two shares of
    rows up to the edge (a two-sample Kolmogorov-Smirnov statistic on the grid). Nulls and NaN are a bucket of their own and no part of the distance.
    """
    before, now = (quantile_sketches(df, columns, size) for df in (reference, current))
    edges = quantile_edges(before, columns, buckets)
    known = [c for c in columns if edges[c]]

    def bucket(c: str) -> Column:
        value = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        passed = sum((F.when(value > e, 1).otherwise(0) for e in edges[c]), F.lit(0))
        return F.when(value.isNotNull(), passed)

    index = drift(reference, current, {c: bucket(c) for c in columns}, least_rows)

    def ranks(sketches: DataFrame, side: str) -> DataFrame:
        none = F.lit(None).cast("array<double>")
        pairs = [
            F.struct(F.lit(c).alias("column"), (
                F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_rank_double(c, F.array(*map(F.lit, edges[c])))) if c in known else none
            ).alias(side)) for c in columns
        ]
        return sketches.select(F.inline(F.array(*pairs)))

    both = ranks(before, "before").join(ranks(now, "now"), "column")
    gaps = F.array_max(F.zip_with("before", "now", lambda a, b: F.abs(a - b)))
    return index.join(both, "column").select(*index.columns, F.round(gaps, 4).alias("distance"))
