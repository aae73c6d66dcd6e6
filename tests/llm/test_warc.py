from __future__ import annotations

import hashlib

import pytest

from casework.llm import warc


def test_round_trip(spark, tmp_path):
    same, small = "<p>é</p>" * 20, "<p>tiny</p>"
    rows = [(5, "http://a/\r\nX: y", same), (2, "http://b/", same), (9, None, same), (None, "http://n/", same), (2, "http://b/", same),
            (3, "u", small), (4, "u", small), (6, "e", None), (7, "e", ""), (8, "l", "z" * 500_000), (None, "m", "only" * 50)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    kind = lambda r: (r.id, r.record_type, r.refers_to)
    assert sorted(map(kind, got), key=repr) == sorted([
        (5, "revisit", 2), (2, "response", None), (2, "response", None), (9, "revisit", 2), (None, "revisit", 2), (3, "response", None),
        (4, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (None, "response", None)], key=repr)
    for r in got:
        assert r.payload_digest == hashlib.sha256(r.payload).hexdigest() and r.payload_bytes == len(r.payload)
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and int(fields["Content-Length"]) == len(rest) - 4 and "X" not in fields
        assert rest == (b"" if r.record_type == "revisit" else bytes(r.payload)) + b"\r\n\r\n"
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 5


def test_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    store = spark.read.parquet(str(tmp_path / "a/payloads"))
    store.selectExpr("digest", "length", "cast(concat(cast(payload as string), '!') as binary) payload", "first_id").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="bad record"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_empty(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0
