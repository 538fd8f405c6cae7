import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from bundlewise import schemas
from bundlewise.functions.timestamps import micros
from bundlewise.operators.bundles import assign_bundles, bundle_heads
from bundlewise.plans.triage import default_prompts
from bundlewise.streaming.bundler import bundle_stream
from bundlewise.streaming.ingest import accepted, decoded_stream, rejected
from bundlewise.streaming.run import DRAIN_KEY
from bundlewise.streaming.worker import BundleWorker

BASE = 1778061600000000  # 2026-05-06T10:00:00Z
SECOND = 1_000_000
IDLE = 60


def _iso(us):
    s, f = divmod(us - BASE, SECOND)
    return f"2026-05-06T{10 + s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{f:06d}Z"


def _message(offset, trace, us, **extra):
    value = {"timestamp": _iso(us), "level": "ERROR", "message": f"m{offset}", "trace_id": trace, **extra}
    return {"topic": "app.logs", "partition": 0, "offset": offset, "value": json.dumps(value)}


class Feed:
    """A folder of message files with rising modification times, one micro-batch each."""

    def __init__(self):
        self.folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        self.input = f"{self.folder}/in"
        os.mkdir(self.input)
        self.n = 0

    def add(self, messages):
        path = f"{self.input}/{self.n:04d}.json"
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(m) for m in messages))
        os.utime(path, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def read(self, spark):
        raw = spark.readStream.schema(schemas.MESSAGE).option("maxFilesPerTrigger", 1).json(self.input)
        return decoded_stream(raw)

    def logs(self, spark):
        return accepted(self.read(spark)).select("trace_id", "ts", "seq", "timestamp", "level", "message")

    def run(self, stream, name="out"):
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", f"{self.folder}/cp-{name}")
            .option("path", f"{self.folder}/{name}")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return query, stream.sparkSession.read.schema(stream.schema).parquet(f"{self.folder}/{name}")


def _random_messages(seed, n=120):
    rng = random.Random(seed)
    us, out = BASE, []
    for i in range(n):
        us += rng.choice([0, SECOND, 5 * SECOND, IDLE * SECOND, (IDLE + 1) * SECOND // 2])
        out.append(_message(i, "hot" if rng.random() < 0.4 else f"t{rng.randrange(4)}", us))
    return out


def _expected(spark, messages, batch_max):
    rows = [(m["offset"], json.loads(m["value"])["trace_id"], json.loads(m["value"])["timestamp"]) for m in messages]
    df = spark.createDataFrame(rows, "seq bigint, trace_id string, timestamp string").withColumn("us", micros(F.to_timestamp("timestamp")))
    heads = bundle_heads(assign_bundles(df, IDLE * SECOND, batch_max), batch_max)
    return sorted((r.trace_id, r.first_us, r.last_us, r.n_logs, r.reason) for r in heads.collect())


def _bundles(df):
    return sorted((r.trace_id, r.first_us, r.last_us, r.n_logs, r.reason) for r in df.collect())


@pytest.mark.parametrize("splits", [1, 4, 9])
def test_bundles_do_not_depend_on_the_cut_into_micro_batches(spark, splits):
    messages = _random_messages(2)
    feed = Feed()
    size = -(-len(messages) // splits)
    for i in range(0, len(messages), size):
        part = messages[i : i + size]
        random.Random(i).shuffle(part)
        feed.add(part)
    feed.add([_message(900, DRAIN_KEY, BASE + 200 * 120 * SECOND)])
    _, out = feed.run(bundle_stream(feed.logs(spark), IDLE, 3, delay="10 minutes"))
    assert _bundles(out.where(F.col("trace_id") != DRAIN_KEY)) == _expected(spark, messages, 3)


def test_restart_from_the_checkpoint_keeps_open_bundles(spark):
    messages = _random_messages(4, 60)
    feed = Feed()
    stream = lambda: bundle_stream(feed.logs(spark), IDLE, 3, delay="10 minutes")
    feed.add(messages[:25])
    _, out = feed.run(stream())
    before = out.count()
    feed.add(messages[25:])
    _, out = feed.run(stream())
    end = BASE + 200 * 120 * SECOND
    feed.add([_message(900, DRAIN_KEY, end)])
    _, out = feed.run(stream())
    assert before < out.count()
    assert _bundles(out.where(F.col("trace_id") != DRAIN_KEY)) == _expected(spark, messages, 3)


def test_arrival_mode_flushes_on_count_at_once(spark):
    feed = Feed()
    feed.add([_message(i, "a", BASE + i * SECOND) for i in range(5)])
    _, out = feed.run(bundle_stream(feed.logs(spark), IDLE, 2, hold=False))
    rows = sorted(out.collect(), key=lambda r: r.first_seq)
    assert [(r.first_seq, r.last_seq, r.reason) for r in rows] == [(0, 1, "batch_full"), (2, 3, "batch_full")]
    assert rows[0].log_text == f"[{_iso(BASE)}] ERROR: m0\n[{_iso(BASE + SECOND)}] ERROR: m1"


def test_late_rows_are_dropped_and_counted(spark):
    feed = Feed()
    feed.add([_message(0, "a", BASE + 3600 * SECOND)])
    feed.add([_message(1, "a", BASE + 3601 * SECOND)])
    feed.add([_message(2, "b", BASE)])  # the engine judges lateness by the watermark of the batch before
    query, _ = feed.run(bundle_stream(feed.logs(spark), IDLE, 3))
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    assert dropped == 1


def test_rejects_keep_the_message_and_a_reason(spark):
    feed = Feed()
    bad = {"topic": "t", "partition": 0, "offset": 7, "value": "{broken"}
    feed.add([_message(0, "a", BASE), _message(1, None, BASE), bad])
    _, out = feed.run(rejected(feed.read(spark)).select("offset", "value", "reject_reason"))
    assert {r.offset: r.reject_reason for r in out.collect()} == {1: "missing trace_id", 7: "not a json object"}


def test_worker_retries_then_dead_letters_and_replays_without_duplicates(spark):
    def analyzer():
        def analyze(system, user, version):
            if "poison" in user:
                raise ValueError("cannot")
            return {"raw_text": '{"category": "DB", "evidence": ["x"]}', "model": "stub"}

        return analyze

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    worker = BundleWorker(folder, default_prompts(spark), analyzer, max_retries=2, pause=0.0)
    bundles = spark.createDataFrame(
        [("a", 0, 0, 0, 0, 1, "idle", "fine"), ("b", 0, 0, 1, 1, 1, "idle", "poison")],
        "trace_id string, first_us bigint, last_us bigint, first_seq bigint, last_seq bigint, n_logs bigint, reason string, log_text string",
    )
    worker(bundles, 0)
    worker(bundles, 0)  # a replayed micro-batch
    assert [r.retries for r in worker.table(spark, "retry").collect()] == [1]
    last = worker.drain(spark, 0)
    assert last == 2
    done = worker.table(spark, "analyses").collect()
    assert [(r.trace_id, r.category, r.evidence) for r in done] == [("a", "db", '["x"]')]
    dead = worker.table(spark, "dlq").collect()
    assert [(r.trace_id, r.retries, r.error) for r in dead] == [("b", 2, "cannot")]


def test_worker_runs_behind_a_stream(spark):
    from bundlewise.plans.triage import stub_analyzer

    feed = Feed()
    feed.add([_message(i, f"t{i % 2}", BASE + i * SECOND) for i in range(8)])
    worker = BundleWorker(f"{feed.folder}/work", default_prompts(spark), stub_analyzer)
    query = (
        bundle_stream(feed.logs(spark), IDLE, 2, hold=False)
        .writeStream.foreachBatch(worker)
        .option("checkpointLocation", f"{feed.folder}/cp-worker")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert query.exception() is None
    rows = worker.table(spark, "analyses").collect()
    assert len(rows) == 4 and {r.root_cause for r in rows} == {"2 of 2 lines are errors"}
