from datetime import UTC, datetime

from pyspark.sql import functions as F

from bundlewise.functions.rounding import round_exact
from bundlewise.functions.timestamps import floor_bucket, iso_utc, month_key, parse_ts

GOOD = {
    "2026-05-06T10:00:00Z": datetime(2026, 5, 6, 10),
    "2026-05-06T10:00:00+05:30": datetime(2026, 5, 6, 4, 30),
    "2026-05-06T10:00:00": datetime(2026, 5, 6, 10),
    " 2026-05-06 10:00:00.25Z\t": datetime(2026, 5, 6, 10, 0, 0, 250000),
    "2026-05-06": datetime(2026, 5, 6),
    "20260506": datetime(2026, 5, 6),
    "20260506T100000Z": datetime(2026, 5, 6, 10),
    "2026-05-06T10:00Z": datetime(2026, 5, 6, 10),
    "2026-05-06T10": datetime(2026, 5, 6, 10),
    "2026-05-06T10+0100": datetime(2026, 5, 6, 9),
    "2026-05-06T10:00:00,5": datetime(2026, 5, 6, 10, 0, 0, 500000),
    "2026-05-06T10:00:00.123456789Z": datetime(2026, 5, 6, 10, 0, 0, 123456),
    "2026-05-06T10:00:00-02": datetime(2026, 5, 6, 12),
    "2026-05-06T10:00:00+05:30:15": datetime(2026, 5, 6, 4, 29, 45),
    "2026-05-06T100000.5-013010": datetime(2026, 5, 6, 11, 30, 10, 500000),
    "\u00a02026-05-06T10:00\u3000": datetime(2026, 5, 6, 10),
    "1969-12-31T23:59:59.999999Z": datetime(1969, 12, 31, 23, 59, 59, 999999),
}
BAD = ["", "2026", "2026-05", "10:00:00", "not-a-time", "2026-13-01", "2026-02-30", "2026-05-06T25:00:00", "2026-05-06T10:00:00 Europe/Paris", "2026-05-06T10:00:00z"]
BAD += ["2026-05-06T10:0000", "2026-05-06T1000:00", "2026-05-06T10:00+05:3015", "2026-05-06T10:00+0530:15"]


def test_parse_ts_accepts_iso_and_rejects_the_rest(spark):
    df = spark.createDataFrame([(t,) for t in [*GOOD, *BAD, None]], "t string")
    got = {r.t: r.x for r in df.select("t", F.unix_micros(parse_ts(F.col("t"))).alias("x")).collect()}
    for text, want in GOOD.items():
        delta = want.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)
        assert got[text] == delta.days * 86_400_000_000 + delta.seconds * 1_000_000 + delta.microseconds, text
    assert all(got[t] is None for t in [*BAD, None])


def test_floor_bucket_is_exact_below_zero_and_for_large_values(spark):
    values = [-1, 0, 9, 10, -10, -11, 1778061600000001, -1778061600000001]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", floor_bucket("v", 10).alias("b"))
    assert all(r.b == r.v // 10 for r in df.collect())


def test_round_exact_equals_python_round(spark):
    values = [0.1235, 0.2415, 0.0625, 0.1875, 2 / 3, 0.0005, 1.0005, 0.0, -0.1235, 0.3835, 0.9995] + [i / 2000 for i in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_exact(F.col("v"), 3).alias("r"))
    assert all(r.r == round(r.v, 3) for r in df.collect())


def test_month_and_iso_rendering(spark):
    row = spark.range(1).select(
        month_key(F.timestamp_micros(F.lit(1778061600000001))).alias("m"), iso_utc(F.timestamp_micros(F.lit(1778061600000001))).alias("i")
    ).first()
    assert (row.m, row.i) == ("2026-05", "2026-05-06T10:00:00.000001Z")
