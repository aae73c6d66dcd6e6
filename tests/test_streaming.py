"""Streams over file sources, compared with sequential or batch results."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from casework import schemas
from casework.models import vectoriser
from casework.operators import strikes
from casework.streaming import intake, ratelimit

START = dt.datetime(2026, 5, 1)


def sequential(rows, limit=3, strict=False):
    windows, out = {}, {}
    day = dt.timedelta(hours=24)
    for at, rid, client in sorted(rows):
        if client in (None, "unknown"):
            out[rid] = (True, None)
            continue
        opened, count = windows.get(client, (None, 0))
        age = None if opened is None else at - opened
        if age is None or (age > day if strict else age >= day):
            windows[client] = (at, 1)
            out[rid] = (True, None)
        elif count >= limit:
            left = day - age
            out[rid] = (False, -(-left // dt.timedelta(hours=1)))
        else:
            windows[client] = (opened, count + 1)
            out[rid] = (True, None)
    return out


def log(seed=3, n=400, days=5):
    draw = random.Random(seed)
    clients = ["hot", "hot", "hot", "a", "b", "unknown", None]
    return [(START + dt.timedelta(minutes=draw.randrange(0, days * 1440)), i, draw.choice(clients)) for i in range(n)]


def verdicts(df):
    return {r["request_id"]: (r["accepted"], r["hours_left"]) for r in df.collect()}


FIXED = [(START + dt.timedelta(hours=h), i, "c") for i, h in enumerate((0, 1, 2, 3, 24))]


@pytest.mark.parametrize("strict,last", [(False, (True, None)), (True, (False, 0))])
def test_window_edges(spark, strict, last):
    df = spark.createDataFrame(FIXED, "at timestamp_ntz, request_id bigint, client string")
    got = verdicts(ratelimit.limit_batch(df, strict=strict))
    assert [got[i] for i in range(4)] == [(True, None)] * 3 + [(False, 21)]
    assert got[4] == last


@pytest.mark.parametrize("days", [1, 5, 60])
@pytest.mark.parametrize("strict", [False, True])
def test_batch_limit_equals_sequential(spark, days, strict):
    rows = log(days=days)
    df = spark.createDataFrame(rows, "at timestamp_ntz, request_id bigint, client string")
    assert verdicts(ratelimit.limit_batch(df, strict=strict)) == sequential(rows, strict=strict)


def test_stream_limit_over_several_triggers(spark, tmp_path):
    rows = sorted(log(5, 300))
    source = tmp_path / "in"
    for i in range(6):
        part = rows[i * 50:(i + 1) * 50]
        df = spark.createDataFrame(part, "at timestamp_ntz, request_id bigint, client string")
        df.coalesce(1).write.mode("append").parquet(str(source / f"slice={i}"))
    for i in range(6):
        for f in (source / f"slice={i}").glob("*.parquet"):
            os.utime(f, (1_000_000 + i * 100, 1_000_000 + i * 100))
    stream = (
        spark.readStream.schema("at timestamp_ntz, request_id bigint, client string, slice int").option("maxFilesPerTrigger", 1)
        .parquet(str(source)).drop("slice")
    )
    out = intake.run_to_table(ratelimit.limit_stream(stream, delay="5 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert verdicts(out) == sequential(rows)


def test_mail_ingest_is_idempotent_and_quarantines(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    mails = [
        {"mail_id": f"m{i % 7}", "from_name": "Asha", "from_addr": f"a{i}@x.y", "subject": "Help", "body": "Kindly unblock my card, Rs 500", "sent_at": "2026-05-01T10:00:00"}
        for i in range(9)
    ]
    for i in range(3):
        lines = [json.dumps(m) for m in mails[i * 3:(i + 1) * 3]]
        (inbox / f"{i}.json").write_text("\n".join(lines + (["{not json"] if i == 1 else [])))

    def run(checkpoint):
        query = intake.start_mail_ingest(
            intake.mail_source(spark, str(inbox), 1), str(tmp_path / "table"), str(tmp_path / "bad"), str(tmp_path / checkpoint),
            "2026-05-29", {"availableNow": True},
        )
        query.awaitTermination()
        assert query.exception() is None

    run("cp1")
    run("cp2")
    table = intake.read_table(spark, str(tmp_path / "table"))
    rows = {r["id"]: r for r in table.collect()}
    assert table.count() == 7 and set(rows) == {f"m{i}" for i in range(7)}
    assert (rows["m0"]["category"], rows["m0"]["sentiment"], rows["m0"]["status"]) == ("Card", "Polite", "auto_resolved_std")
    assert rows["m0"]["complaint_text"].startswith("Subject: Help")
    # The second run numbers its triggers anew and replaces what the first one set aside.
    assert spark.read.schema("_broken string").json(str(tmp_path / "bad")).count() == 1


def test_ingest_compares_with_stored_cases_and_reads_no_whole_table(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(4):
        mail = {"mail_id": f"m{i}", "from_name": "Asha" if i != 2 else "Other", "from_addr": "a@x.y", "subject": "Help",
                "body": "my loan" + " and more" * 700 + " is gone, upi" * (i % 2), "sent_at": f"2026-05-0{i + 1}T10:00:00"}
        (inbox / f"{i}.json").write_text(json.dumps(mail))
        os.utime(inbox / f"{i}.json", (1_000_000 + i * 100, 1_000_000 + i * 100))
    same = lambda text: F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))
    query = intake.start_mail_ingest(
        intake.mail_source(spark, str(inbox), 1), str(tmp_path / "table"), str(tmp_path / "bad"), str(tmp_path / "cp"), "2026-05-29",
        {"availableNow": True}, vectors=same,
    )
    query.awaitTermination()
    assert query.exception() is None
    rows = {r["id"]: r for r in intake.read_table(spark, str(tmp_path / "table")).collect()}
    assert {k: r["duplicate_of"] for k, r in rows.items()} == {"m0": None, "m1": "m0", "m2": None, "m3": "m0"}
    # Words at the end of a text beyond any former cut count.
    assert {k: r["category"] for k, r in rows.items()} == {"m0": "Loan", "m1": "UPI", "m2": "Loan", "m3": "UPI"}
    assert all(len(r["complaint_text"]) > 6000 for r in rows.values())
    asked = spark.createDataFrame([("m1",)], "id string")
    found = intake.in_buckets(spark, str(tmp_path / "table"), schemas.CASE, asked, "id")
    assert {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()} == {str(asked.select(intake._bucket("id")).first()[0])}
    assert "m1" in {r["id"] for r in found.collect()}
    assert intake.in_buckets(spark, str(tmp_path / "none"), schemas.CASE, asked, "id").count() == 0


def test_ingest_finds_duplicates_across_triggers_with_a_stored_vectoriser(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    bodies = ["my card was charged twice at the petrol pump", "loan statement is missing since april", "my card was charged twice at the petrol pump again",
              "please send the loan statement of may"]
    texts = spark.createDataFrame([(b,) for b in bodies], "body string")
    halves = [vectoriser.counts(texts.limit(2), "body"), vectoriser.counts(texts.offset(2), "body")]
    fitted = vectoriser.TextVectoriser.of(vectoriser.merged(*halves), "2026-05")
    assert fitted == vectoriser.TextVectoriser.of(vectoriser.counts(texts, "body"), "2026-05") and fitted.texts == 4
    fitted.save(spark, str(tmp_path / "vectoriser"))
    stored = vectoriser.TextVectoriser.load(spark, str(tmp_path / "vectoriser"))
    assert stored == fitted
    lengths = spark.createDataFrame([("a b b",), ("",), (None,)], "t string").select(stored(F.col("t")).alias("v")).collect()
    assert [round(sum(x * x for x in r["v"]), 5) for r in lengths] == [1.0, 0.0, 0.0]
    for i, body in enumerate(bodies):
        mail = {"mail_id": f"m{i}", "from_name": "Asha", "from_addr": "a@x.y", "subject": "Help", "body": body, "sent_at": f"2026-05-0{i + 1}T10:00:00"}
        (inbox / f"{i}.json").write_text(json.dumps(mail))
        os.utime(inbox / f"{i}.json", (1_000_000 + i * 100, 1_000_000 + i * 100))
    query = intake.start_mail_ingest(
        intake.mail_source(spark, str(inbox), 2), str(tmp_path / "table"), str(tmp_path / "bad"), str(tmp_path / "cp"), "2026-05-29",
        {"availableNow": True}, vectors=stored,
    )
    query.awaitTermination()
    assert query.exception() is None
    rows = {r["id"]: r for r in intake.read_table(spark, str(tmp_path / "table")).collect()}
    assert {k: r["duplicate_of"] for k, r in rows.items()} == {"m0": None, "m1": None, "m2": "m0", "m3": None}
    assert rows["m2"]["similarity"] > 0.78


def test_strike_stream_blocks_like_the_batch_form(spark, tmp_path):
    rows = [(i, "A", START + dt.timedelta(minutes=i)) for i in range(16)] + [(99, "B", START)]
    df = spark.createDataFrame(rows, "id bigint, account_number string, created_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        intake.blocked_accounts(stream).writeStream.format("memory").queryName("blocked_now").outputMode("update")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [r["account_number"] for r in spark.table("blocked_now").collect()] == ["A"]
    batch = strikes.blocked_accounts(df, START + dt.timedelta(hours=20))
    assert [r["account_number"] for r in batch.collect()] == ["A"]


def test_later_strikes_do_not_hide_a_blocking_day(spark, tmp_path):
    rows = [(i, "A", START + dt.timedelta(minutes=i)) for i in range(15)]
    rows += [(100 + i, "A", START + dt.timedelta(days=1, minutes=i)) for i in range(14)] + [(200 + i, "A", START + dt.timedelta(days=2, minutes=i)) for i in range(14)]
    df = spark.createDataFrame(rows, "id bigint, account_number string, created_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    batch = strikes.blocked_accounts(df, START + dt.timedelta(days=2, hours=1)).collect()
    assert [(r["account_number"], r["strikes_on_worst_day"]) for r in batch] == [("A", 15)]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    days = intake.run_updates_to_table(intake.strikes_per_day(stream), str(tmp_path / "out"), str(tmp_path / "cp"), ["account_number", "day"], "strikes")
    assert sorted(r["strikes"] for r in days.collect()) == [14, 14, 15]
    assert days.where(F.col("strikes") >= strikes.STRIKES_TO_BLOCK).count() == 1


def test_recorded_strikes_are_appended(spark):
    old = spark.createDataFrame([(1, "A", START)], schemas.STRIKES)
    out = strikes.record(old, spark.createDataFrame([("B",)], "account_number string"), START)
    assert out.count() == 2 and out.where("account_number = 'B'").first()["created_at"] == START


def test_time_zone_does_not_change_the_stream(spark, tmp_path):
    rows = [(START + dt.timedelta(hours=h), i, "c") for i, h in enumerate((0, 1, 2, 17, 23, 24))]
    df = spark.createDataFrame(rows, "at timestamp_ntz, request_id bigint, client string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out = intake.run_to_table(ratelimit.limit_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert verdicts(out) == sequential(rows)
        assert {r["at"] for r in out.select(F.col("at").cast("timestamp_ntz").alias("at")).collect()} == {r[0] for r in rows}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
