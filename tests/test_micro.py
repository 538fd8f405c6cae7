import random

import pytest
from pyspark.sql import functions as F

from bundlewise.operators import ordered
from bundlewise.plans.triage import default_prompts, stub_analyzer
from bundlewise.sources.commits import CommittedTables
from bundlewise.sources.files import folders
from bundlewise.sources.stores import latest_analysis
from bundlewise.streaming.ingest import decoded_stream
from bundlewise.streaming.micro import PROCESSING, StreamBundler, TriageStream, run_available

from test_streams import BASE, IDLE, SECOND, Feed, _bundles, _expected, _iso, _message, _random_messages

MESSAGE = "topic string, `partition` int, `offset` bigint, value string"


def _batch(spark, messages):
    rows = [(m["topic"], m["partition"], m["offset"], m["value"]) for m in messages]
    return decoded_stream(spark.createDataFrame(rows, MESSAGE))


@pytest.mark.parametrize("splits", [1, 5])
def test_bundles_do_not_depend_on_the_cut_into_batches(spark, splits):
    messages = _random_messages(2)
    feed = Feed()
    size = -(-len(messages) // splits)
    for i in range(0, len(messages), size):
        part = messages[i : i + size]
        random.Random(i).shuffle(part)
        feed.add(part)
    target = StreamBundler(spark, f"{feed.folder}/tables", idle_seconds=IDLE, batch_max=3, delay_seconds=600)
    run_available(feed.read(spark), target, f"{feed.folder}/cp")
    assert _bundles(target.bundles()) == _expected(spark, messages, 3)
    assert target.raw_logs().count() == len(messages)
    # nothing is left of the state but the newest, empty one
    assert len(folders(spark, f"{target.tables.root}/_carried")) <= splits + 2
    assert sum(len(folders(spark, f"{target.tables.root}/_carried/{r}")) for r in folders(spark, f"{target.tables.root}/_carried")) == 1


def test_a_busy_trace_is_cut_into_cells(spark, monkeypatch):
    """With cells of ten rows one trace of a batch is ranked by many tasks; the bundles are the same."""
    monkeypatch.setattr(ordered.choose_cells, "__defaults__", ("us", 10, False, 0))
    messages = [_message(i, "hot", BASE + i * SECOND // 4) for i in range(150)]
    feed = Feed()
    target = StreamBundler(spark, f"{feed.folder}/tables", idle_seconds=IDLE, batch_max=7)
    target(_batch(spark, messages[:70]), 0)
    target(_batch(spark, messages[70:]), 1)
    target.drain()
    rows = sorted(target.bundles().collect(), key=lambda r: r.first_seq)
    assert [(r.first_seq, r.n_logs) for r in rows] == [(i, min(7, 150 - i)) for i in range(0, 150, 7)]
    assert rows[0].log_text.split("\n")[0] == f"[{_iso(BASE)}] ERROR: m0"


def test_late_rows_are_rejected_as_late_and_kept_as_raw_logs(spark):
    feed = Feed()
    target = StreamBundler(spark, f"{feed.folder}/tables", idle_seconds=IDLE, batch_max=9)
    target(_batch(spark, [_message(0, "a", BASE + 3600 * SECOND)]), 0)
    target(_batch(spark, [_message(1, "b", BASE), _message(2, None, BASE)]), 1)
    assert {r.offset: r.reject_reason for r in target.rejected().collect()} == {1: "late", 2: "missing trace_id"}
    assert target.raw_logs().count() == 2
    target.drain()
    assert [r.trace_id for r in target.bundles().collect()] == ["a"]
    counted = {(r.run, r.name): r.n for r in target.counters().collect()}
    assert counted["stream-1", "logs_late"] == 1 and counted["stream-0", "open_rows"] == 1


def test_processing_time_closes_idle_bundles_by_the_clock(spark):
    now = [1000.0]
    feed = Feed()
    target = StreamBundler(spark, f"{feed.folder}/tables", mode=PROCESSING, idle_seconds=IDLE, batch_max=3, clock=lambda: now[0])
    # arrival order counts, whatever the times in the records say
    target(_batch(spark, [_message(0, "a", BASE + 9 * SECOND), _message(1, "a", BASE), _message(2, "b", BASE)]), 0)
    assert target.bundles().count() == 0
    now[0] += IDLE - 1
    target(_batch(spark, [_message(3, "a", BASE), _message(4, "a", BASE)]), 1)
    got = [(r.trace_id, r.first_seq, r.last_seq, r.reason) for r in target.bundles().collect()]
    assert got == [("a", 0, 3, "batch_full")]
    now[0] += 1  # b is idle now, the rest of a is not
    target.tick()
    assert ("b", 2, 2, "idle") in [(r.trace_id, r.first_seq, r.last_seq, r.reason) for r in target.bundles().collect()]
    assert target.bundles().count() == 2
    now[0] += IDLE
    target.tick()
    rows = sorted((r.trace_id, r.first_seq, r.last_seq, r.reason) for r in target.bundles().collect())
    assert rows == [("a", 0, 3, "batch_full"), ("a", 4, 4, "idle"), ("b", 2, 2, "idle")]
    first = [r for r in target.bundles().collect() if r.reason == "batch_full"][0]
    assert first.log_text.split("\n")[0].endswith("m0") and (first.first_us, first.last_us) == (BASE, BASE + 9 * SECOND)


def _poisoned():
    def make():
        def analyze(system, user, version):
            if "poison" in user:
                raise ValueError("cannot")
            return {"raw_text": '{"category": "DB", "evidence": ["x"]}', "model": "gpt-4o", "prompt_tokens": 100, "completion_tokens": 10}

        return analyze

    return make


def _triage(spark, folder, **kw):
    return TriageStream(spark, f"{folder}/tables", default_prompts(spark), kw.pop("analyzer", None) or _poisoned(), pause=0.0, idle_seconds=IDLE, batch_max=2, **kw)


def test_failed_bundles_are_retried_and_their_records_shipped(spark):
    feed = Feed()
    poison = [_message(k, "bad", BASE + k * SECOND, note="poison") for k in (0, 1)]
    for m in poison:
        m["value"] = m["value"].replace(f'm{m["offset"]}', "poison")
    target = _triage(spark, feed.folder, max_retries=2)
    target(_batch(spark, poison + [_message(2, "good", BASE)]), 0)
    target(_batch(spark, [_message(3, "other", BASE + 9000 * SECOND)]), 1)
    waiting = target._state("_waiting", "bundle_id string, retries int").collect()
    assert [r.retries for r in waiting] == [1] and target.dead_letters().count() == 0
    target.drain()
    assert sorted(r.trace_id for r in target.analyses().collect()) == ["good", "other"]
    dead = sorted(target.dead_letters().collect(), key=lambda r: r.offset)
    # the original records, one row each
    assert [(r.trace_id, r.offset, r.value, r.retries, r.error) for r in dead] == [("bad", m["offset"], m["value"], 2, "cannot") for m in poison]
    calls = target.calls()
    assert calls.where("status = 'error'").count() == 3 and calls.where("status = 'ok'").count() == 2
    assert calls.agg(F.sum("prompt_tokens")).first()[0] == 200
    totals = {r.name: r.n for r in target.counters().groupBy("name").agg(F.sum("n").alias("n")).collect()}
    assert (totals["bundle_retries"], totals["bundles_dlq"], totals["calls_ok"], totals["calls_error"]) == (2, 1, 2, 3)


@pytest.mark.parametrize("stops_at", ["raw_logs", "analyses", "commit"])
def test_a_batch_that_stops_half_way_and_is_replayed_leaves_every_table_exact(spark, monkeypatch, stops_at):
    messages = [_message(i, f"t{i % 3}", BASE + i * SECOND) for i in range(9)] + [{"topic": "t", "partition": 0, "offset": 99, "value": "{"}]
    feed = Feed()
    target = _triage(spark, feed.folder, analyzer=stub_analyzer)
    target(_batch(spark, messages[:4]), 0)
    write, commit = CommittedTables.write, CommittedTables.commit

    def killed(self, rows, table, run, attempt, by=None):
        write(self, rows, table, run, attempt, by)
        if table == stops_at:
            raise KeyboardInterrupt  # after its files are there

    monkeypatch.setattr(CommittedTables, "write", killed)
    if stops_at == "commit":
        monkeypatch.setattr(CommittedTables, "commit", lambda self, record: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        target(_batch(spark, messages[4:] + [_message(50, "late", BASE + 5000 * SECOND)]), 1)
    monkeypatch.setattr(CommittedTables, "write", write)
    monkeypatch.setattr(CommittedTables, "commit", commit)
    again = _triage(spark, feed.folder, analyzer=stub_analyzer)  # a new process reads the state from the tables
    again(_batch(spark, messages[4:] + [_message(50, "late", BASE + 5000 * SECOND)]), 1)
    again(_batch(spark, messages[4:]), 1)  # a batch the engine repeats although it was committed
    again.drain()
    assert again.raw_logs().count() == 10 and again.rejected().count() == 1
    assert sorted((r.trace_id, r.log_text.count("\n") + 1) for r in again.analyses().collect()) == sorted([(f"t{k}", n) for k in range(3) for n in (2, 1)] + [("late", 1)])
    assert again.calls().count() == 7
    assert latest_analysis(again.analyses()).count() == 4


def test_raw_logs_are_best_effort(spark, monkeypatch):
    from pyspark.errors import AnalysisException

    feed = Feed()
    target = _triage(spark, feed.folder, analyzer=stub_analyzer)
    write = CommittedTables.write

    def broken(self, rows, table, run, attempt, by=None):
        write(self, rows, table, run, attempt, by)
        if table == "raw_logs":
            raise AnalysisException("disk full")

    monkeypatch.setattr(CommittedTables, "write", broken)
    target(_batch(spark, [_message(0, "a", BASE)]), 0)
    target.drain()
    assert target.raw_logs().count() == 0 and target.analyses().count() == 1  # files of the failed write are not read
    assert {r.name: r.n for r in target.counters().where("run = 'stream-0'").collect()}["raw_logs_failed"] == 1


def test_unknown_versions_and_modes_are_errors(spark):
    feed = Feed()
    with pytest.raises(ValueError, match="unknown prompt version: v9"):
        _triage(spark, feed.folder, version="v9")
    with pytest.raises(ValueError, match="unknown mode"):
        StreamBundler(spark, feed.folder, mode="other")


def test_an_empty_batch_is_committed(spark):
    feed = Feed()
    target = _triage(spark, feed.folder, analyzer=stub_analyzer)
    target(_batch(spark, []), 0)
    target.drain()
    assert target.analyses().count() == 0 and target.tables.last("stream").batch_id == 0


def test_a_bundle_is_staged_once_and_a_timestamp_parsed_once(spark, monkeypatch):
    feed, staged = Feed(), []
    stage = StreamBundler._staged
    monkeypatch.setattr(StreamBundler, "_staged", lambda self, rows, table, *a: (staged.append(table), stage(self, rows, table, *a))[1])
    target = _triage(spark, feed.folder, analyzer=stub_analyzer)
    batch = _batch(spark, [_message(i, f"t{i % 2}", BASE + i * SECOND) for i in range(5)])
    target(batch, 0)
    assert staged == ["_arrived", "_groups", "_answered"]
    target.drain()
    assert sorted((r.trace_id, r.log_text.count("\n") + 1) for r in target.analyses().collect()) == [("t0", 1), ("t0", 2), ("t1", 2)]
    # the shape check of the usual form stands in the plan once
    assert batch._jdf.queryExecution().optimizedPlan().toString().count(r"^\d{4}-\d{2}-\d{2}([T ]") == 1
