import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from bundlewise.llm import revisits

from .helpers import SF, crowded

CAPTURE = "record_id bigint, url string, at timestamp, status int, headers map<string,string>"
T0 = datetime(2026, 1, 1)


def captures(spark, rows):
    return crowded(spark.createDataFrame(rows, CAPTURE))


def test_spellings_of_one_address(spark):
    same = ["http://www.H.org", "https://h.org:443/", "H.org/#x", "http://u:p@h.org:80/", "  http://h.org/?#y"]
    more = {"http://h.org/A?b=2&a=1": "h.org/A?a=1&b=2", "http://h.org:8080/a": "h.org:8080/a", "http://www2.h.org/a%20b": "h.org/a%20b", "": "/"}
    df = spark.createDataFrame([(u,) for u in [*same, *more, None]], "u string").select("u", revisits.canonical_url(F.col("u")).alias("c"))
    got = {r["u"]: r["c"] for r in df.collect()}
    assert {got[u] for u in same} == {"h.org/"} and {u: got[u] for u in more} == more and got[None] is None


def test_headers_of_a_resolved_revisit(spark):
    rows = [
        (1, "http://h.org/a", T0, 200, {"ETag": '"x"', "Content-Type": "text/html", "Content-Length": "9", "Connection": "close", "Cache-Control": "old"}),
        (2, "http://h.org/a", T0 + timedelta(1), 304, {"etag": 'W/"x"', "content-length": "0", "cache-control": "new", "Keep-Alive": "5", "Age": "1"}),
    ]
    r = revisits.resolve(captures(spark, rows)).first()
    assert (r["state"], r["response_id"]) == ("resolved", 1)
    assert r["headers"] == {"etag": 'W/"x"', "content-type": "text/html", "content-length": "9", "cache-control": "new", "age": "1"}


def brute(rows):
    out = {}
    for i, url, at, status, head in rows:
        if status != 304:
            continue
        before = [r for r in rows if r[3] == 200 and r[1] == url and url is not None and at is not None and r[2] is not None and r[2] < at]
        best = max(before, key=lambda r: (r[2], r[0]), default=None)
        low = {k.lower(): v for k, v in (head or {}).items()}
        theirs = {k.lower(): v for k, v in ((best or [None] * 5)[4] or {}).items()}
        if best is None:
            out[i] = ("no earlier response", None)
        elif "etag" in low:
            out[i] = ("resolved", best[0]) if low["etag"].removeprefix("W/") == theirs.get("etag", "-").removeprefix("W/") else ("validator mismatch", None)
        elif "last-modified" in low:
            out[i] = ("resolved", best[0]) if low["last-modified"] == theirs.get("last-modified") else ("validator mismatch", None)
        else:
            out[i] = ("resolved", best[0])
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_resolution_equals_brute_force(spark, partitions):
    """One address with a third of all captures, equal instants, other states, missing addresses and times."""
    rng = random.Random(partitions)
    heads = [None, {}, {"ETag": '"a"'}, {"ETag": 'W/"a"'}, {"ETag": '"b"'}, {"Last-Modified": "m"}, {"Last-Modified": "n"}, {"ETag": '"a"', "Last-Modified": "m"}]
    rows = [
        (i, None if rng.random() < 0.05 else "http://hot.org/" if rng.random() < 0.4 else f"http://h.org/{rng.randrange(30)}",
         None if rng.random() < 0.05 else T0 + timedelta(seconds=rng.randrange(60)), rng.choice([200, 304, 304, 404]), rng.choice(heads))
        for i in range(600)
    ]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions * 3))
    try:
        got = {r["record_id"]: (r["state"], r["response_id"]) for r in revisits.resolve(captures(spark, rows).repartition(partitions)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)


def test_empty_and_repeated_rows(spark):
    assert revisits.resolve(captures(spark, [])).count() == 0
    long = "http://h.org/" + "x" * 100_000
    rows = [(1, long, T0, 200, None), (2, long, T0 + timedelta(1), 304, None), (2, long, T0 + timedelta(1), 304, None), (None, long, T0 + timedelta(2), 304, {})]
    got = revisits.resolve(captures(spark, rows)).collect()
    assert sorted((str(r["record_id"]), r["state"], r["response_id"]) for r in got) == [("2", "resolved", 1), ("2", "resolved", 1), ("None", "resolved", 1)]


def test_query_equals_its_statement(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    got = sorted(map(repr, map(tuple, revisits.op2_warc_revisits(spark, SF).collect())))
    assert got == sorted(map(repr, con.execute(revisits.OP2_SQL).fetchall()))
