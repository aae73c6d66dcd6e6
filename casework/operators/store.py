"""Table maintenance: A2, A3, A5, A6, A8, A9, A15, A16, C6, C7, C9, C10, F1, G1-G3, K22."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework import schemas
from casework.functions.labels import reply_subject, standard_reply
from casework.operators.skew import attach_by_key


def newest_first(df: DataFrame, date_col: str = "date", id_col: str = "id") -> DataFrame:
    """F1."""
    return df.orderBy(F.col(date_col).desc_nulls_last(), F.col(id_col).desc())


def scan(df: DataFrame, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """A2: filter, newest first, optional top-n."""
    out = newest_first(df if where is None else df.where(where))
    return out.limit(limit) if limit else out


def known_keys(requests: DataFrame, dimension: DataFrame, key: str, spread: str) -> DataFrame:
    """A3: every request with `known`; a missing or unknown key is false.

    Requests are counted per key before the lookup, so a key asked for by a third of them is looked up once.
    """
    keys = dimension.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    asked = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_w"))
    per_key = asked.join(keys, F.col(key) == F.col("_k"), "left").select(key, "_w", F.col("_k").isNotNull().alias("known"))
    joined = attach_by_key(requests, per_key, key, "_w", spread)
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))


def first_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by `order`; partial aggregation keeps a copied key out of one task."""
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rows.columns if c not in order and c != key])
    best = rows.groupBy(key).agg(F.min(packed).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in rows.columns])


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "id", order: Sequence[str] = ("date",)) -> DataFrame:
    """Existing rows win; of several new rows with one id the smallest by `order` is taken.

    Columns the new rows lack are filled with nulls.
    """
    fresh = first_per_key(new.where(F.col(key).isNotNull()), key, [c for c in order if c in new.columns])
    fresh = fresh.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def check_updatable(fields: Iterable[str], allowed: Sequence[str] = schemas.UPDATABLE) -> None:
    unknown = sorted(set(fields) - set(allowed))
    if unknown:
        raise ValueError(f"not updatable: {unknown}")


def patch(base: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Overwrite whitelisted columns. A patch column `x` applies where `x_set` is true (or is absent).

    `patches` has one row per key. Writing null is possible: the flag decides, not the value.
    """
    fields = [c for c in patches.columns if c != key and not c.endswith("_set")]
    check_updatable(fields)
    renamed = patches.select(
        F.col(key).alias("_pk"),
        *[F.col(c).alias(f"_p_{c}") for c in fields],
        *[
            (F.col(f"{c}_set") if f"{c}_set" in patches.columns else F.lit(True)).alias(f"_s_{c}")
            for c in fields
        ],
    )
    joined = base.join(renamed, base[key] == F.col("_pk"), "left")

    def merged(field: T.StructField) -> Column:
        if field.name not in fields:
            return F.col(field.name)
        new = F.col(f"_p_{field.name}").cast(field.dataType)
        return F.when(F.col(f"_s_{field.name}"), new).otherwise(F.col(field.name)).alias(field.name)

    added = [c for c in fields if c not in base.columns]
    return joined.select(
        *[merged(f) for f in base.schema.fields],
        *[F.when(F.col(f"_s_{c}"), F.col(f"_p_{c}")).alias(c) for c in added],
    )


def audit_trail(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str], actor: str) -> DataFrame:
    """One row per changed case with its old and new state."""
    old = before.select(F.col(key), F.struct(*fields).alias("_old"))
    new = after.select(F.col(key).alias("_ak"), F.struct(*fields).alias("_new"))
    changed = old.join(new, F.col(key) == F.col("_ak")).where(~F.col("_old").eqNullSafe(F.col("_new")))
    options = {"ignoreNullFields": "false"}
    return changed.select(
        F.col(key).alias("complaint_id"),
        F.lit(actor).alias("actor"),
        F.lit("update").alias("action"),
        F.to_json("_old", options).alias("before_state"),
        F.to_json("_new", options).alias("after_state"),
    )


def copy_table(source: DataFrame, target: DataFrame, schema: T.StructType, key: str = "id") -> DataFrame:
    """Conform the source and add the rows whose id the target lacks."""
    return insert_if_absent(schemas.conform(target, schema), schemas.conform(source, schema), key)


def outbox(cases: DataFrame, users: DataFrame, portal_channels: Sequence[str] = ("portal",)) -> DataFrame:
    """Reply address = own address, else the portal account's; only rows with a draft."""
    drafted = cases.where(F.col("draft_response").isNotNull() & (F.col("draft_response") != ""))
    needs_account = F.nullif(F.col("customer_email"), F.lit("")).isNull() & F.col("channel").isin(*portal_channels)
    keyed = drafted.withColumn("_lookup", F.when(needs_account, F.col("account_no")))
    accounts = users.select(F.col("account_no").alias("_account"), F.col("email").alias("_user_email"))
    wanted = keyed.where(F.col("_lookup").isNotNull()).groupBy("_lookup").agg(F.count("*").alias("_w"))
    per_account = wanted.join(accounts, F.col("_lookup") == F.col("_account")).drop("_account")
    joined = attach_by_key(keyed, per_account, "_lookup", "_w", "id")
    address = F.coalesce(F.nullif(F.col("customer_email"), F.lit("")), F.nullif(F.col("_user_email"), F.lit("")))
    return joined.select(
        "id",
        address.alias("to_email"),
        reply_subject(F.col("id")).alias("subject"),
        F.col("draft_response").alias("body"),
    ).where(F.col("to_email").isNotNull())


def with_drafts(cases: DataFrame, days: Column) -> DataFrame:
    """H29 applied to every case that is not a duplicate."""
    reply = standard_reply(F.col("id"), F.col("customer_name"), F.col("category"), days)
    return cases.withColumn("draft_response", F.when(F.col("duplicate_of").isNull(), reply))


def allocate_ids(new: DataFrame, start_after: Column | int, key: str, as_of, date_col: str = "date",
                 prefix: str = "UBI-") -> DataFrame:
    """Consecutive ids in (date, digest of key, key) order; a missing filing date becomes `as_of`.

    No window runs over the whole table. Rows fall into 256 digest ranges per day. Ranges are numbered by a running
    sum over their counts (first within the day, then over the days) and rows by `row_number` inside a range, so the
    largest task holds 1/256 of a day even when every row was filed on the same day. The numbering and the join
    with the offsets use the same partitioning, so the rows are shuffled once.
    """
    dated = new.withColumn(date_col, F.coalesce(F.col(date_col), F.lit(str(as_of)).cast("date")))
    digest = F.md5(F.col(key).cast("string"))
    ranged = dated.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, 2))
    part = [date_col, "_range"]
    counts = ranged.groupBy(*part).agg(F.count("*").alias("_n"))
    within = counts.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy(date_col).orderBy("_range")) - F.col("_n")
    )
    per_day = counts.groupBy(date_col).agg(F.sum("_n").alias("_day_n"))
    # One row per calendar day: the only unpartitioned window, over a table of days.
    day_start = per_day.select(
        date_col, (F.sum("_day_n").over(Window.orderBy(date_col)) - F.col("_day_n")).alias("_day_before")
    )
    offsets = within.join(day_start, date_col).select(*part, (F.col("_before") + F.col("_day_before")).alias("_offset"))
    position = F.row_number().over(Window.partitionBy(*part).orderBy("_digest", key))
    base = start_after if isinstance(start_after, Column) else F.lit(start_after)
    numbered = ranged.withColumn("_pos", position).join(offsets, part).withColumn(
        "_number", base + F.col("_offset") + F.col("_pos")
    )
    width = F.greatest(F.lit(4), F.char_length(F.col("_number").cast("string")))
    return numbered.select(
        F.concat(F.lit(prefix), F.lpad(F.col("_number").cast("string"), width, F.lit("0"))).alias("new_id"),
        *new.columns,
    )


def last_number(existing: DataFrame, key: str = "id", prefix: str = "UBI-") -> Column:
    """Highest allocated suffix as a scalar; the row count would collide after a delete."""
    suffix = F.regexp_extract(F.col(key).cast("string"), f"^{prefix}(\\d+)$", 1).try_cast("bigint")
    return existing.agg(F.coalesce(F.max(suffix), F.lit(0)).alias("n")).scalar()


def dangling_references(children: DataFrame, reference: str, parents: DataFrame, key: str, name: str) -> DataFrame:
    """Referenced keys without a parent and how many rows use each.

    References are counted before the join, so many rows pointing at one parent arrive as one.
    """
    used = children.where(F.col(reference).isNotNull()).groupBy(F.col(reference).alias("_ref")).agg(
        F.count("*").alias("rows")
    )
    keys = parents.select(F.col(key).alias("_key"))
    return used.join(keys, F.col("_ref") == F.col("_key"), "left_anti").select(
        F.lit(name).alias("reference"), F.col("_ref").cast("string").alias("missing_key"), "rows"
    )


def originals(cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every duplicate with columns of its original; one original may have a third of all rows."""
    duplicates = cases.where(F.col("duplicate_of").isNotNull())
    weight = duplicates.groupBy("duplicate_of").agg(F.count("*").alias("copies"))
    found = cases.select(F.col("id").alias("_oid"), *[F.col(c).alias(f"original_{c}") for c in columns])
    per_original = weight.join(found, F.col("duplicate_of") == F.col("_oid"), "inner").drop("_oid")
    return attach_by_key(duplicates, per_original, "duplicate_of", "copies", "id")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Filter choices."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def without(pool: DataFrame, picked: DataFrame, key: str = "id") -> DataFrame:
    """G2."""
    return pool.join(picked.select(key), key, "left_anti")


def replace_alerts(alerts: DataFrame, path: str) -> None:
    """The alert table is replaced as a whole."""
    alerts.write.mode("overwrite").parquet(path)


def latest_alerts(alerts: DataFrame, limit: int = 20) -> DataFrame:
    """A9."""
    return alerts.orderBy(F.col("id").desc()).limit(limit)
