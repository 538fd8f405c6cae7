import json
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bundlewise.functions.timestamps import micros
from bundlewise.operators import metrics as M
from bundlewise.sources import logs as L
from bundlewise.sources import stores as S


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _decoded(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq bigint, value string")
    return L.decode(df)


T = "2026-05-06T10:00:00Z"
RECORDS = [
    json.dumps({"trace_id": "t1", "timestamp": T, "level": "ERROR", "message": "ok"}),
    json.dumps({"timestamp": T, "level": "ERROR", "message": "no trace"}),
    json.dumps({"trace_id": "t3", "level": "ERROR"}),
    json.dumps({"trace_id": "t4", "timestamp": T, "extra": "kept", "n": 5, "deep": {"a": [1, None]}}),
    json.dumps({"trace_id": "", "timestamp": T}),
    json.dumps({"trace_id": "t6", "timestamp": "soon"}),
    json.dumps({"trace_id": "t7", "timestamp": 5}),
    json.dumps({"trace_id": None, "timestamp": T, "level": None}),
    "[1, 2]",
    '{"trace_id": "t9", ',
    "plain text",
    "",
]


def test_validation_gives_a_reason_and_never_fails(spark):
    got = {r.seq: r.reject_reason for r in L.validate(_decoded(spark, RECORDS)).collect()}
    assert got == {
        0: None, 1: "missing trace_id", 2: "missing timestamp", 3: None, 4: "missing trace_id", 5: "unreadable timestamp",
        6: "unreadable timestamp", 7: "missing trace_id", 8: "not a json object", 9: "not a json object",
        10: "not a json object", 11: "not a json object",
    }
    good, bad = L.split_valid(_decoded(spark, RECORDS))
    assert (good.count(), bad.count()) == (2, 10)


def test_raw_rows_have_defaults_and_the_residual_payload(spark):
    rows = {r.trace_id: r for r in L.raw_log_rows(_decoded(spark, RECORDS)).withColumn("us", micros(F.col("ts"))).collect()}
    assert set(rows) == {"t1", "t4"}
    assert rows["t1"].payload is None and rows["t1"].day == "2026-05-06"
    assert (rows["t4"].level, rows["t4"].message) == ("INFO", "")
    assert json.loads(rows["t4"].payload) == {"extra": "kept", "n": 5, "deep": {"a": [1, None]}}


def test_raw_log_table_round_trip_prunes_days(spark, folder, make_logs):
    logs = make_logs([("a", "2026-05-06T23:59:59Z", "I", "x"), ("a", "2026-05-07T00:00:00Z", "I", "y")])
    S.write_raw_logs(L.raw_log_rows(logs), folder)
    one = S.read_raw_logs(spark, folder).where("day = '2026-05-07'")
    assert [r.message for r in one.collect()] == ["y"]
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()


def test_sources_are_labelled_and_missing_columns_are_null(spark):
    a = spark.createDataFrame([("t1", "p")], "trace_id string, payload string")
    b = spark.createDataFrame([("t2",)], "trace_id string")
    out = {r.trace_id: (r.source, r.payload) for r in L.union_sources({"kafka": a, "http": b}).collect()}
    assert out == {"t1": ("kafka", "p"), "t2": ("http", None)}


def test_client_key(spark):
    rows = [("1.1.1.1, 2.2.2.2", "h"), (" 3.3.3.3 ", "h"), ("", "h"), (None, "h"), (None, None)]
    df = spark.createDataFrame(rows, "f string, h string").select(L.client_key(F.col("f"), F.col("h")).alias("k"))
    assert [r.k for r in df.collect()] == ["1.1.1.1", "3.3.3.3", "h", "h", "unknown"]


def test_oversize_requests_are_refused_whole(spark):
    df = spark.range(12).selectExpr("id", "case when id < 8 then 'big' else 'small' end as request")
    assert {r.request: r.is_oversize for r in L.request_sizes(df, "request", 5).collect()} == {"big": True, "small": False}
    assert {r.request for r in L.within_request_limit(df, "request", 5).collect()} == {"small"}
    assert not L.request_sizes(df, "request", 8).where("is_oversize").count()


def _analyses(spark):
    rows = [
        (1, "t1", "old", datetime(2026, 3, 31, 23, 59)), (2, "t1", "new", datetime(2026, 4, 1)), (3, "t1", "newer", datetime(2026, 4, 1)),
        (4, "t2", "only", datetime(2025, 12, 31)),
    ]
    return spark.createDataFrame(rows, "id bigint, trace_id string, analysis string, created_at timestamp")


def test_analyses_by_month_latest_and_retention(spark, folder):
    S.write_analyses(_analyses(spark), folder)
    stored = S.read_analyses(spark, folder)
    assert {r.created_month: r["count"] for r in stored.groupBy("created_month").count().collect()} == {"2026-03": 1, "2026-04": 2, "2025-12": 1}
    assert {r.trace_id: r.analysis for r in S.latest_analysis(stored).collect()} == {"t1": "newer", "t2": "only"}
    one = S.analysis_of(stored, "t1")
    assert one.first().created_at == "2026-04-01T00:00:00.000000Z"
    assert S.analysis_of(stored, "nope").count() == 0
    kept = S.drop_before(stored, "2026-01")
    assert kept.count() == 3 and "created_month" in kept._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    S.write_analyses(_analyses(spark).where("id = 4"), folder)  # a later batch is appended
    assert S.read_analyses(spark, folder).count() == 5


def test_dropping_old_months_of_a_catalog_table(spark):
    name = "analyses_retention_test"
    spark.sql(f"drop table if exists {name}")
    S.append_analyses_table(_analyses(spark), name)
    S.append_analyses_table(_analyses(spark).where("id = 4"), name)
    assert S.drop_old_months(spark, name, "2026-04") == ["2025-12", "2026-03"]
    assert sorted(r.id for r in spark.table(name).collect()) == [2, 3]
    spark.sql(f"drop table {name}")


def test_a_hot_month_is_written_by_several_tasks(spark, folder):
    rows = spark.range(0, 200_000, 1, 8).selectExpr("id", "concat('t', id) as trace_id", "sha2(cast(id as string), 512) as analysis", "timestamp'2026-05-06' as created_at")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4MB")
    try:
        S.write_analyses(rows, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = S.read_analyses(spark, folder)
    assert back.count() == 200_000 and len(back.inputFiles()) > 2


def test_columns_added_later_are_null_in_older_files(spark, folder):
    S.write_analyses(_analyses(spark).where("id = 1"), folder)
    S.write_analyses(_analyses(spark).where("id = 2").withColumn("category", F.lit("db")), folder)
    assert {r.id: r.category for r in S.read_analyses(spark, folder).collect()} == {1: None, 2: "db"}


def test_eval_case_source_and_results(spark, folder):
    cases = [{"id": "a", "logs": [{"timestamp": T, "trace_id": "t"}], "expected_keywords": ["x"], "anti_keywords": [], "gold": "g"}, {"id": "b", "logs": []}]
    path = f"{folder}/cases.json"
    with open(path, "w") as f:
        json.dump(cases, f)
    assert S.read_eval_cases(spark, path).count() == 2
    assert S.read_eval_cases(spark, path, "a").first().logs[0].trace_id == "t"
    with pytest.raises(ValueError):
        S.read_eval_cases(spark, path, "zzz")
    S.write_eval_results(spark.range(3).toDF("id"), spark.range(1).toDF("n"), f"{folder}/out")
    a, b = S.read_eval_results(spark, f"{folder}/out")
    assert (a.count(), b.count()) == (3, 1)


def test_embedding_cache_round_trip(spark, folder):
    rows = spark.createDataFrame([("m", "x", [1.0])], "model string, text string, vector array<double>")
    S.append_embedding_cache(rows, folder)
    S.append_embedding_cache(rows.withColumn("text", F.lit("y")), folder)
    assert sorted(r.text for r in S.read_embedding_cache(spark, folder).collect()) == ["x", "y"]


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("s", v) for v in (0.5, 0.6, 4.0, 61.0)], "service string, latency_s double")
    got = {r.le: r.n for r in M.latency_histogram(df, ["service"]).collect()}
    assert got == {"0.5": 1, "1.0": 2, "2.0": 2, "5.0": 3, "10.0": 3, "20.0": 3, "30.0": 3, "60.0": 3, "+Inf": 4}


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 200])
def test_p95_is_the_value_at_the_truncated_rank(spark, n):
    values = [((i * 7919) % 101) / 1000 + (i % 3) * 0.0001 for i in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 0.25)] * 50, "g string, latency_s double")
    got = {r.g: r for r in M.latency_summary(df, ["g"]).collect()}
    assert got["a"].p95_s == sorted(values)[max(int(0.95 * n) - 1, 0)]
    assert (got["b"].p95_s, got["b"].rate_per_s) == (0.25, 4.0)
    assert got["a"].mean_s == pytest.approx(sum(values) / n)
