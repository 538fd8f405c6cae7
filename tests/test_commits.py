import os
import tempfile

import pytest
from pyspark.sql import functions as F

from bundlewise import schemas
from bundlewise.operators.governance import daily_spend
from bundlewise.plans.triage import analyzed_bundles, default_prompts, run_job, stub_analyzer
from bundlewise.sources import stores as S
from bundlewise.sources.commits import Commit, CommittedTables
from bundlewise.sources.files import exists, folders

ROWS = [("a", "2026-05-06T10:00:00Z", "ERROR", "x"), ("a", "2026-05-06T10:00:01Z", "INFO", "y"), ("b", "2026-05-06T12:00:00Z", None, None)]
NUMBERS = "n bigint"


@pytest.fixture
def tables(spark):
    return CommittedTables(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/tables")


def _numbers(tables, name="numbers"):
    return sorted(r.n for r in tables.read(name, NUMBERS).collect())


def test_rows_count_once_their_run_is_committed(spark, tables):
    assert _numbers(tables) == [] and tables.last("s") is None
    tables.write(spark.range(3).toDF("n"), "numbers", "r1", "a1")
    assert _numbers(tables) == []
    tables.commit(Commit("s", "r1", "a1", 0, tables=("numbers",)))
    tables.write(spark.range(10, 12).toDF("n"), "numbers", "r2", "a2")  # never committed
    assert _numbers(tables) == [0, 1, 2]
    # the same run again: the newest committed attempt counts, also while the next one is being written
    tables.write(spark.range(5, 6).toDF("n"), "numbers", "r1", "a3")
    assert _numbers(tables) == [0, 1, 2]
    tables.commit(Commit("s", "r1", "a3", 1, tables=("numbers",)))
    assert _numbers(tables) == [5] and tables.last("s").attempt == "a3"
    # a run whose newest attempt did not store the table has no rows in it
    tables.commit(Commit("s", "r1", "a4", 2))
    assert _numbers(tables) == []


def test_vacuum_removes_what_no_reader_takes(spark, tables):
    for attempt in ("a1", "a2", "a3"):
        tables.write(spark.range(1).toDF("n"), "numbers", "r1", attempt)
    tables.write(spark.range(1).toDF("n"), "numbers", "r2", "b1")
    tables.commit(Commit("s", "r1", "a2", 0, tables=("numbers",)))
    assert tables.vacuum("numbers", running=frozenset({"r2"})) == 2
    assert folders(spark, f"{tables.root}/numbers/run=r1") == ["attempt=a2"] and exists(spark, tables.path("numbers", "r2", "b1"))
    assert tables.vacuum("numbers") == 1 and _numbers(tables) == [0]


def test_a_repeated_job_leaves_one_set_of_rows(spark, tables, make_logs):
    at = F.lit("2026-05-06 10:00:00").cast("timestamp")
    for _ in range(2):
        seen = run_job(make_logs(ROWS), default_prompts(spark), stub_analyzer, tables, "day-6", created_at=at)
    assert seen == {"windows_correlated": 2, "calls_ok": 2, "calls_error": 0, "attempts": 2, "raw_logs_saved": 1}
    stored = tables.read("analyses", schemas.ANALYSIS)
    assert sorted(r.trace_id for r in stored.collect()) == ["a", "b"]
    assert tables.read("raw_logs", schemas.RAW_LOG).count() == 3
    # another run is added, and readers of the plain table apply
    run_job(make_logs(ROWS[:2]), default_prompts(spark), stub_analyzer, tables, "day-7", created_at=at + F.expr("interval 1 day"))
    assert stored.sparkSession.read and tables.read("analyses", schemas.ANALYSIS).count() == 3
    newest = {r.trace_id: r.created_month for r in S.latest_analysis(tables.read("analyses", schemas.ANALYSIS).drop("run")).collect()}
    assert newest == {"a": "2026-05", "b": "2026-05"}
    calls = tables.read("calls", schemas.CALL)
    spend = {r.day: r.n_calls for r in daily_spend(calls).collect()}
    assert spend == {"2026-05-06": 2, "2026-05-07": 1} and calls.where("prompt_tokens > 0").count() == 3
    assert not exists(spark, f"{tables.root}/_answered/run=day-6/attempt={tables.last('job:day-6').attempt}")


def test_a_job_that_stops_has_stored_nothing(spark, tables, make_logs, monkeypatch):
    monkeypatch.setattr(CommittedTables, "commit", lambda self, record: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        run_job(make_logs(ROWS), default_prompts(spark), stub_analyzer, tables, "r")
    assert tables.read("analyses", schemas.ANALYSIS).count() == 0 and tables.read("raw_logs", schemas.RAW_LOG).count() == 0


def test_one_long_bundle_is_one_failed_row(spark, tables, make_logs):
    long = [("long", f"2026-05-06T10:00:{i % 60:02d}.{i:06d}Z", "INFO", "m") for i in range(40)]
    logs = make_logs(long + [("short", "2026-05-06T20:00:00Z", "ERROR", "m")])
    done = {r.trace_id: r for r in analyzed_bundles(logs, default_prompts(spark), stub_analyzer, max_lines=30).collect()}
    assert done["long"].error == "bundle of 40 lines; max_lines is 30" and done["long"].attempts == 0 and done["long"].raw_text is None
    assert done["short"].error is None and done["short"].category == "upstream"
    seen = run_job(logs, default_prompts(spark), stub_analyzer, tables, "r", max_lines=30)
    assert (seen["calls_ok"], seen["calls_error"]) == (1, 1)
    assert [(r.trace_id, r.error) for r in tables.read("failed", "trace_id string, n_logs bigint, prompt_version string, attempts int, error string").collect()] == [
        ("long", "bundle of 40 lines; max_lines is 30")]
    assert tables.read("calls", schemas.CALL).count() == 1  # it was never sent


def test_a_bundle_in_many_parts_is_refused_once(spark):
    logs = spark.range(20_000).selectExpr("id as seq", "'t' as trace_id", "date_format(timestamp_micros(1778061600000000 + id), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") as timestamp",
                                          "'INFO' as level", "'m' as message")
    done = analyzed_bundles(logs, default_prompts(spark), stub_analyzer, max_lines=17_000).collect()
    assert [(r.trace_id, r.n_logs, r.log_text) for r in done] == [("t", 20_000, None)]


def test_texts_of_a_job_are_not_sorted_to_be_written(spark, tables, make_logs, monkeypatch):
    """One time for all rows is one month: the stored answers need no sort by it, which would spill their texts."""
    plans, write = {}, CommittedTables.write

    def spy(self, rows, table, *a, **k):
        plans[table] = rows._jdf.queryExecution().optimizedPlan().toString()
        write(self, rows, table, *a, **k)

    monkeypatch.setattr(CommittedTables, "write", spy)
    at = F.lit("2026-05-06 10:00:00").cast("timestamp")
    run_job(make_logs(ROWS), default_prompts(spark), stub_analyzer, tables, "day-6", created_at=at)
    assert "2026-05 AS created_month" in plans["analyses"]
    stored = tables.read("analyses", schemas.ANALYSIS)
    assert {(r.created_month, r.at) for r in stored.select("created_month", stored.created_at.cast("string").alias("at")).collect()} == {("2026-05", "2026-05-06 10:00:00")}


def _analyses(spark, months):
    rows = [(i, f"t{i}", m) for i, m in enumerate(months)]
    df = spark.createDataFrame(rows, "id bigint, trace_id string, m string")
    return df.select("id", "trace_id", F.to_timestamp(F.concat("m", F.lit("-15"))).alias("created_at"))


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_old_months_of_a_path_are_deleted_and_no_other_is_touched(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/analyses"
    S.write_analyses(_analyses(spark, ["2025-11", "2025-12", "2026-01", "2026-01"]), path)
    before = {f: t for f, t in _files(path).items() if "2026-01" in f}
    assert S.drop_old_months_of_path(spark, path, "2026-01") == ["2025-11", "2025-12"]
    assert _files(path) == before and sorted(r.id for r in S.read_analyses(spark, path).collect()) == [2, 3]
    assert S.drop_old_months_of_path(spark, path, "2026-01") == [] and S.drop_old_months_of_path(spark, path + "-none", "2026-01") == []


def test_old_months_go_from_committed_tables_too(spark, tables):
    for k, run in enumerate(["r1", "r2"]):
        tables.write(S.analysis_rows(_analyses(spark, ["2025-11", "2026-01"])), "analyses", run, "a", "created_month")
        tables.commit(Commit(run, run, "a", k, tables=("analyses",)))
    assert S.drop_old_months_of_path(spark, f"{tables.root}/analyses", "2026-01") == ["2025-11"]
    assert {r.created_month for r in tables.read("analyses", schemas.ANALYSIS).collect()} == {"2026-01"}
    assert tables.read("analyses", schemas.ANALYSIS).count() == 2


def test_a_month_is_replaced_alone(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/analyses"
    S.write_analyses(_analyses(spark, ["2025-12", "2026-01", "2026-01"]), path)
    before = {f: t for f, t in _files(path).items() if "2025-12" in f}
    S.replace_months(_analyses(spark, ["x", "2026-01"]).where("id = 1"), path)
    after = _files(path)
    assert before and before.items() <= after.items()
    assert sorted(r.id for r in S.read_analyses(spark, path).collect()) == [0, 1]


def test_equal_ids_are_settled_by_the_wider_key(spark):
    rows = spark.createDataFrame([(7, "t", "2026-01-01", "aa", "old"), (7, "t", "2026-01-01", "bb", "new")], "id bigint, trace_id string, d string, uid string, analysis string")
    newest = S.latest_analysis(rows.withColumn("created_at", F.to_timestamp("d")))
    assert [r.analysis for r in newest.collect()] == ["new"]
