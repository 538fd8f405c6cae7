"""What streaming queries report about each batch, kept as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = (
    "query string, run_id string, batch_id bigint, at timestamp, rows_in bigint, rows_late bigint, open_rows bigint, "
    "duration_ms bigint, watermark string, counters map<string,bigint>"
)


class ProgressTable(StreamingQueryListener):
    """A listener that appends one row per batch: gauges (rows held in state, duration) and observed counters.

    Counters are what the query states by `observe`: they are counted while the rows pass by, not by scans of their own.
    `names` limits the table to some queries. Register it with `spark.streams.addListener`.
    """

    def __init__(self, spark: SparkSession, path: str, names: frozenset[str] | None = None):
        self.spark, self.path, self.names = spark, path, names

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        if self.names is not None and p.get("name") not in self.names:
            return
        state = p.get("stateOperators", [])
        observed = {k: int(v) for row in (p.get("observedMetrics") or {}).values() for k, v in row.items() if isinstance(v, (int, float))}
        row = (
            p.get("name"), p["runId"], p["batchId"], p["timestamp"], p.get("numInputRows", 0),
            sum(s.get("numRowsDroppedByWatermark", 0) for s in state), sum(s.get("numRowsTotal", 0) for s in state),
            p.get("batchDuration", 0), (p.get("eventTime") or {}).get("watermark"), observed,
        )
        made = self.spark.createDataFrame([row], PROGRESS.replace("at timestamp", "at string"))
        made.withColumn("at", made["at"].cast("timestamp")).coalesce(1).write.mode("append").parquet(self.path)


def batch_counters(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch; where a batch was repeated, its last report."""
    rows = spark.read.schema(PROGRESS).parquet(path)
    latest = rows.groupBy("query", "batch_id").agg({"at": "max"}).withColumnRenamed("max(at)", "at")
    return rows.join(latest, ["query", "batch_id", "at"], "left_semi")
