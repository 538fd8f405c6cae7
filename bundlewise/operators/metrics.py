"""Counters and latency statistics as aggregates over event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: upper bounds in seconds of the latency histogram
LATENCY_BOUNDS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0)


def _le(bound: float) -> str:
    return str(bound)


def counters(parts: Mapping[str, tuple[DataFrame, Column] | tuple[DataFrame, Column, Column]], day: str = "day") -> DataFrame:
    """Counts per day, metric and label from several event frames: name -> (frame with `day`, label[, condition]).

    Counters given over the same frame are counted in one pass: each row brings the names of the counters it adds to.
    """
    frames: dict[int, tuple[DataFrame, list[Column]]] = {}
    for name, (df, label, *condition) in parts.items():
        entry = F.struct(F.lit(name).alias("metric"), label.alias("label"))
        frames.setdefault(id(df), (df, []))[1].append(F.when(condition[0], entry) if condition else entry)
    out: DataFrame | None = None
    for df, entries in frames.values():
        named = df.select(F.col(day).alias("day"), F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
        one = named.groupBy("day", "metric", "label").agg(F.count("*").alias("n")).select("day", "metric", "label", "n")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no counters given")
    return out


def latency_histogram(calls: DataFrame, by: Sequence[str] = (), latency: str = "latency_s") -> DataFrame:
    """Cumulative buckets (`le`, `n`) with total count and sum: one aggregate, then one row per bound."""
    value = F.col(latency)
    agg = calls.groupBy(*by).agg(
        *[F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS)],
        F.count(value).alias("count"),
        F.sum(value).alias("sum"),
    )
    rows = [F.struct(F.lit(_le(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(LATENCY_BOUNDS)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return agg.select(*by, "count", "sum", F.inline(F.array(*rows)))


#: Bins per unit in the search for a rank, coarse ones first: milliseconds, then microseconds of the one millisecond.
QUANTILE_BINS = (1e3, 1e6)


def quantile_value(values: DataFrame, by: Sequence[str], value: str, fraction: float, bins: Sequence[float] = QUANTILE_BINS) -> DataFrame:
    """Exact value at rank max(floor(fraction * n), 1) per group, from distinct values with their count `cnt`.

    The bin that holds the rank is found by sums over bins, then cut into finer bins, and only the values of the last
    one are ordered, so no group is sorted as a whole and a crowded bin is spread again. A NULL group is a group.
    """
    group = Window.partitionBy("_k")
    upto = group.rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_upto") - F.col("cnt")
    left = values.withColumn("_k", F.struct(*by) if by else F.struct(F.lit(1)))
    need = left.groupBy("_k").agg(F.greatest(F.floor(F.sum("cnt") * F.lit(fraction)), F.lit(1)).alias("_need"))
    for width in bins:
        left = left.withColumn("_b", F.floor(F.col(value) * width))
        counted = left.groupBy("_k", "_b").agg(F.sum("cnt").alias("cnt")).withColumn("_upto", F.sum("cnt").over(upto.orderBy("_b")))
        hit = counted.join(need, "_k").where((F.col("_upto") >= F.col("_need")) & (before < F.col("_need")))
        hit = hit.select("_k", "_b", (F.col("_need") - before).alias("_need"))
        left = left.join(hit.select("_k", "_b"), ["_k", "_b"], "left_semi").drop("_b")
        need = hit.drop("_b")
    inside = left.withColumn("_upto", F.sum("cnt").over(upto.orderBy(value))).join(need, "_k")
    return inside.where((F.col("_upto") >= F.col("_need")) & (before < F.col("_need"))).select(*by, F.col(value).alias("value_at_rank"))


def latency_summary(calls: DataFrame, by: Sequence[str], latency: str = "latency_s") -> DataFrame:
    """Count, mean, p95 and rate per group; p95 is the value at rank max(floor(0.95 n), 1), not interpolated.

    Equal latencies are merged before anything is ordered. A NULL group is a group like any.
    """
    key = list(by)
    present = calls.where(F.col(latency).isNotNull())
    totals = present.groupBy(*key).agg(F.count("*").alias("n"), F.avg(latency).alias("mean_s"))
    distinct = present.groupBy(*key, latency).agg(F.count("*").alias("cnt"))
    p95 = quantile_value(distinct, key, latency, 0.95).select(F.struct(*key).alias("_k"), "value_at_rank")
    rate = F.lit(1.0) / F.nullif("mean_s", F.lit(0.0))
    return totals.withColumn("_k", F.struct(*key)).join(p95, "_k").select(
        *key, "n", "mean_s", F.col("value_at_rank").alias("p95_s"), rate.alias("rate_per_s")
    )
