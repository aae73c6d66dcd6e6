"""Fixed-window request limit I4, I5, I8: streaming and batch form.

A client's window opens with its first request, allows a few requests and rejects the rest; the first request at or
after the window's length opens the next one. The anchor of a window therefore depends on the one before it, which no
built-in window expresses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casework.session import cut_lineage

MAX_REQUESTS = 3
WINDOW_MS = 24 * 60 * 60 * 1000
UNLIMITED = "unknown"
_HOUR_MS = 60 * 60 * 1000
_SPREAD = 256
_FREE = "\u0000"


def _step(limit: int, strict: bool):
    window = WINDOW_MS * 1000

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # One client's rows of one trigger; the trigger's file limit bounds them.
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["at_us", "request_id"], ignore_index=True)
        if key[0].startswith(_FREE):
            yield rows[["client", "request_id", "at_us"]].assign(accepted=True, hours_left=pd.Series([None] * len(rows), dtype="Int64"))
            return
        first, count = state.get if state.exists else (None, 0)
        accepted, hours = [], []
        for at in rows["at_us"].tolist():
            age = None if first is None else at - first
            if age is None or (age > window if strict else age >= window):
                first, count = at, 0
            if count < limit:
                count += 1
                accepted.append(True)
                hours.append(None)
            else:
                accepted.append(False)
                hours.append(-(-(window - age) // (_HOUR_MS * 1000)))
        state.update((first, count))
        state.setTimeoutTimestamp(max(first // 1000 + WINDOW_MS + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[["client", "request_id", "at_us"]].assign(accepted=accepted, hours_left=pd.Series(hours, dtype="Int64"))

    return judge


def limit_stream(requests: DataFrame, limit: int = MAX_REQUESTS, strict: bool = False, delay: str = "1 hour") -> DataFrame:
    """I4, or I5 with `strict`: client, request_id, at (timestamp) with accepted and hours_left (I8).

    Feed triggers in event-time order: a row behind the watermark is dropped and counted by the query's progress.
    Requests of the unlimited client are spread over many keys, as they share no state.
    """
    free = F.concat(F.lit(_FREE), F.pmod(F.xxhash64("request_id"), F.lit(_SPREAD)).cast("string"))
    key = F.when(F.col("client").isNull() | (F.col("client") == UNLIMITED), free).otherwise(F.col("client"))
    id_type = requests.schema["request_id"].dataType.simpleString()
    # The state function works on epoch microseconds, so it does not depend on the session's time zone.
    judged = (
        requests.withColumn("at", F.col("at").cast("timestamp"))
        .withWatermark("at", delay)
        .select("client", "request_id", F.unix_micros("at").alias("at_us"), "at", key.alias("_key"))
        .groupBy("_key")
        .applyInPandasWithState(
            _step(limit, strict),
            f"client string, request_id {id_type}, at_us bigint, accepted boolean, hours_left bigint",
            "first_us bigint, count int",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return judged.select("client", "request_id", F.timestamp_micros("at_us").alias("at"), "accepted", "hours_left")


_WINDOW_US, _CELL_US, _DAY_US = WINDOW_MS * 1000, _HOUR_MS * 1000, 24 * _HOUR_MS * 1000


def _successors(instants: DataFrame, strict: bool) -> DataFrame:
    """client, us, next: the first instant that reopens a window opened at `us`; the last instants of a client have none.

    Questions (the instants 24 hours on) and instants meet in (client, hour) cells, where one backward pass in time
    answers them; a question that its cell cannot answer takes the first instant of the client's next filled cell.
    """
    asked = instants.select("client", (F.col("us") + _WINDOW_US).alias("at"), F.col("us").alias("asks"))
    both = asked.unionByName(instants.select("client", F.col("us").alias("at"), F.lit(None).cast("long").alias("asks")))
    both = both.withColumn("cell", F.floor(F.col("at") / _CELL_US)).withColumn("found", F.when(F.col("asks").isNull(), F.col("at")))
    # Backwards, an instant that may answer stands before the question: at equal time only when the window is not strict.
    tie = F.col("asks").isNull() if strict else F.col("asks").isNotNull()
    back = Window.partitionBy("client", "cell").orderBy(F.col("at").desc(), tie)
    inside = both.withColumn("next", F.last("found", ignorenulls=True).over(back)).where(F.col("asks").isNotNull())
    # A row per client and hour of the log.
    cells = both.groupBy("client", "cell").agg(F.min("found").alias("first"))
    behind = Window.partitionBy("client").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("client", "cell", F.last("first", ignorenulls=True).over(behind).alias("later"))
    answered = inside.join(cells, ["client", "cell"]).select("client", F.col("asks").alias("us"), F.coalesce("next", "later").alias("next"))
    return answered.where(F.col("next").isNotNull())


def _openers(instants: DataFrame, strict: bool) -> DataFrame:
    """client, opened: the chain of successors from each client's first instant, by doubling the jumps.

    Rounds grow with the logarithm of the number of windows in the log, whatever the number of requests.
    """
    opened = instants.groupBy("client").agg(F.min("us").alias("us"))
    jumps = cut_lineage(_successors(instants, strict))
    while not jumps.isEmpty():
        reached = opened.join(jumps, ["client", "us"]).select("client", F.col("next").alias("us"))
        opened = cut_lineage(opened.unionByName(reached).distinct())
        further = jumps.select("client", F.col("us").alias("next"), F.col("next").alias("_next"))
        jumps = cut_lineage(jumps.join(further, ["client", "next"]).select("client", "us", F.col("_next").alias("next")))
    return opened.withColumnRenamed("us", "opened")


def limit_batch(requests: DataFrame, limit: int = MAX_REQUESTS, strict: bool = False) -> DataFrame:
    """The same verdicts over a finished log: request_id, client, at, accepted, hours_left.

    Openers are 24 hours apart, so a client has one at most on a day, and a request's window was opened on its own day or the day
    before: two joins on exact keys. A rank limit then finds the last accepted request of every window, and a
    request is accepted when it does not come after it. One way for clients of every size.
    """
    rows = requests.select("request_id", "client", F.col("at").cast("timestamp_ntz").alias("at"))
    free = F.col("client").isNull() | (F.col("client") == UNLIMITED)
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("at"))
    limited = cut_lineage(rows.where(~free).withColumn("us", us))
    openers = cut_lineage(_openers(limited.select("client", "us").distinct(), strict).withColumn("day", F.floor(F.col("opened") / _DAY_US)))
    day = F.floor(F.col("us") / _DAY_US)
    today = openers.select("client", "day", F.col("opened").alias("today"))
    before = openers.select("client", (F.col("day") + 1).alias("day"), F.col("opened").alias("before"))
    placed = limited.withColumn("day", day).join(today, ["client", "day"], "left").join(before, ["client", "day"], "left")
    placed = cut_lineage(placed.select(
        "request_id", "client", "at", "us", F.when(F.col("today") <= F.col("us"), F.col("today")).otherwise(F.col("before")).alias("opened")
    ))
    turn = F.row_number().over(Window.partitionBy("client", "opened").orderBy("us", "request_id"))
    allowed = placed.withColumn("_turn", turn).where(F.col("_turn") <= limit)
    last = allowed.groupBy("client", "opened").agg(F.max(F.struct("us", "request_id")).alias("_last"))
    judged = placed.join(cut_lineage(last), ["client", "opened"])
    accepted = F.struct("us", "request_id") <= F.col("_last")
    left = F.lit(_WINDOW_US) - (F.col("us") - F.col("opened"))
    verdicts = judged.select(
        "request_id", "client", "at", accepted.alias("accepted"), F.when(~accepted, F.ceil(left / _CELL_US)).alias("hours_left")
    )
    unlimited = rows.where(free).select("request_id", "client", "at", F.lit(True).alias("accepted"), F.lit(None).cast("long").alias("hours_left"))
    return verdicts.unionByName(unlimited)
