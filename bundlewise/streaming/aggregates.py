"""Windowed streaming aggregates: sessions, spend and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlewise.operators.governance import call_cost


def session_stream(logs: DataFrame, idle_seconds: int, delay: str) -> DataFrame:
    """Idle-only bundles of (trace_id, ts) without Python state.

    The session window merges rows exactly one gap apart, the rule here splits them: one microsecond less.
    """
    gap = f"{idle_seconds * 1_000_000 - 1} microseconds"
    agg = logs.withWatermark("ts", delay).groupBy("trace_id", F.session_window("ts", gap)).agg(
        F.count("*").alias("n_logs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return agg.select(
        "trace_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n_logs"
    )


def spend_stream(calls: DataFrame, delay: str = "48 hours") -> DataFrame:
    """Spend per UTC day; a day stays open for late calls as long as the ledger keeps it."""
    costed = call_cost(calls).withWatermark("ts", delay)
    agg = costed.groupBy(F.window("ts", "1 day")).agg(F.sum("cost").alias("spent"), F.count("*").alias("n_calls"))
    return agg.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "spent", "n_calls")


def counter_stream(logs: DataFrame, label: str = "source", every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    agg = logs.withWatermark("ts", delay).groupBy(F.window("ts", every), label).agg(F.count("*").alias("n"))
    return agg.select(F.unix_micros("window.start").alias("from_us"), label, "n")
