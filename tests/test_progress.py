import time

from pyspark.sql import functions as F

from bundlewise.operators.metrics import counters
from bundlewise.streaming.bundler import bundle_stream
from bundlewise.streaming.progress import ProgressTable, batch_counters
from bundlewise.streaming.run import open_buffers

from test_streams import BASE, IDLE, SECOND, Feed, _message


def test_batch_counters_of_three_batches(spark):
    feed = Feed()
    for k in range(3):
        feed.add([_message(10 * k + i, f"t{i}" if i else None, BASE + (k * 100 + i) * SECOND) for i in range(k + 2)])
    path = f"{feed.folder}/progress"
    listener = ProgressTable(spark, path, frozenset({"watched"}))
    spark.streams.addListener(listener)
    try:
        seen = feed.read(spark).observe(
            "triage", F.count("*").alias("logs_ingested"), F.count_if(F.col("reject_reason").isNotNull()).alias("logs_rejected")
        )
        query = (
            seen.writeStream.queryName("watched").format("noop").option("checkpointLocation", f"{feed.folder}/cp").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        rows, until = [], time.time() + 30
        while len(rows) < 3 and time.time() < until:  # reports arrive after their batch
            time.sleep(0.5)
            rows = batch_counters(spark, path).orderBy("batch_id").collect() if listener.spark else []
    finally:
        spark.streams.removeListener(listener)
    assert [(r.batch_id, r.rows_in, r.counters["logs_ingested"], r.counters["logs_rejected"]) for r in rows] == [(0, 2, 2, 1), (1, 3, 3, 1), (2, 4, 4, 1)]
    assert all(r.query == "watched" and r.duration_ms > 0 and r.open_rows == 0 for r in rows)


def test_open_buffers_of_the_stateful_bundler(spark):
    feed = Feed()
    feed.add([_message(i, f"t{i}", BASE + i * SECOND) for i in range(3)])
    query, _ = feed.run(bundle_stream(feed.logs(spark), IDLE, 9))
    assert open_buffers(query) >= 3  # nothing was closed: the watermark has not passed any row by the idle time


def test_counters_of_one_frame_are_counted_in_one_pass(spark):
    df = spark.createDataFrame([("d1", "a", True), ("d1", "b", False), ("d2", "a", True), ("d2", None, True)], "day string, k string, ok boolean")
    other = spark.createDataFrame([("d1",)], "day string")
    got = counters({"all": (df, F.col("k")), "good": (df, F.lit(""), F.col("ok")), "more": (other, F.lit("x"))})
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [
        ("d1", "all", "a", 1), ("d1", "all", "b", 1), ("d2", "all", "a", 1), ("d2", "all", None, 1), ("d1", "good", "", 1), ("d2", "good", "", 2), ("d1", "more", "x", 1)]))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2
