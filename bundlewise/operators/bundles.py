"""Count-or-idle bundles of a trace: the batch twin of the stateful stream operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlewise.operators.ordered import Cells, run_positions

BATCH_MAX = 200
IDLE_SECONDS = 60


def assign_bundles(
    logs: DataFrame,
    idle_us: int = IDLE_SECONDS * 1_000_000,
    batch_max: int = BATCH_MAX,
    keys: Sequence[str] = ("trace_id",),
    cells: Cells | None = None,
) -> DataFrame:
    """Adds `session` and `bundle` (both from 1) to logs with `us` and `seq`.

    A session ends where the next log of the trace is at least `idle_us` away; within it every `batch_max`
    logs make a bundle. A full bundle empties the buffer, so counting within the session is enough.
    """
    runs = run_positions(logs, keys, gap_us=idle_us, cells=cells)
    return runs.select(
        *logs.columns,
        F.col("run_id").alias("session"),
        F.expr(f"(run_pos - 1) div {batch_max} + 1").alias("bundle"),
    )


def bundle_heads(assigned: DataFrame, batch_max: int = BATCH_MAX, keys: Sequence[str] = ("trace_id",)) -> DataFrame:
    """One row per bundle: size, first and last instant, and why it was flushed."""
    return assigned.groupBy(*keys, "session", "bundle").agg(
        F.count("*").alias("n_logs"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    ).withColumn("reason", F.when(F.col("n_logs") >= batch_max, "batch_full").otherwise("idle"))
