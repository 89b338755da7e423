"""WARC round trips."""

import base64
import gzip
import hashlib

import pytest

from kinetrail.llm import warc


def test_records_of_gzip_members():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nab\r\n\r\ncd\n\r\n\r\n"
    data = gzip.compress(one) + gzip.compress(one)
    for step in (1, 2, 7, 1 << 20):  # parts that end anywhere
        for archive in (data, one + one, gzip.compress(one) + b"\0" * 9 + gzip.compress(one) + b"\0"):
            assert [b for _, b in warc.records_in(warc.inflated(archive, step))] == [b"ab\r\n\r\ncd\n"] * 2
    assert list(warc.records_in(warc.inflated(b""))) == [] == list(warc.records_in(warc.inflated(gzip.compress(b""))))
    with pytest.raises(ValueError):
        list(warc.records_in(warc.inflated(one + b"no record")))


def test_inflation_holds_a_record_at_most():
    """64 records of 1 MB that compress to little: the peak stays at a few records."""
    import tracemalloc

    one = b"WARC/1.1\r\nContent-Length: 1000000\r\n\r\n" + b"a" * 1_000_000 + b"\r\n\r\n"
    data = gzip.compress(one * 64)
    tracemalloc.start()
    assert sum(len(b) for _, b in warc.records_in(warc.inflated(data))) == 64_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000


def test_round_trip(spark):
    long = "x\r\n\r\nWARC/1.1\r\n" * 40_000
    bodies = [None, "", "a", "é\r\n", "a", "", long, long, "WARC/1.1\r\n\r\n", "\r\n", "﻿z", "a\x00b"]
    rows = [(100 - i, f"http://x/{i}" if i % 3 else None, b, "x", 1) for i, b in enumerate(bodies)]
    rows += [(7, "u\r\nX: y", "twice", "x", 1)] * 2 + [(None, "n", "a", "x", 1), (None, "n", "alone", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, body string, rid long").repartition(3)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, b, *_ in rows:
        if i is not None:
            first[b or ""] = min(first.get(b or "", i), i)
    want = []
    for i, _, b, *_ in rows:
        raw = (b or "").encode()
        f = first.get(b or "")
        again = f is not None and f != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_min_bytes_and_nested_rows(spark):
    from kinetrail.plans.stage import fresh_path

    pages = spark.createDataFrame([(1, "u", "tiny"), (2, "u", "tiny"), (3, "u", "larger"), (4, "u", "larger")], "page_id long, url string, html string")
    path = fresh_path(spark, "archives")
    warc.write_archives(pages, path, min_bytes=5)
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert sorted((bytes(r.metadata.payload).decode().strip(), r.type) for r in got) == [
        ("page-id: 1", "response"), ("page-id: 2", "response"), ("page-id: 3", "response"), ("page-id: 4", "revisit")]
    assert all(r.request.target_uri == "u" for r in got)


def test_sql_agrees(spark):
    import duckdb
    from oracle import rows_of

    from kinetrail.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    rel = con.execute(warc.SQL)
    names = [c[0] for c in rel.description]
    got = QUERIES["op7_warc"](spark, d)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, rel.fetchall())
