"""Cost ledger, daily cap, sliding-window admission, failure streaks, retries and replay offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.functions.rounding import round_exact
from bundlewise.functions.timestamps import utc_day
from bundlewise.operators.admission import rate_limit_admission as rate_limit_admission
from bundlewise.operators.ordered import Cells, run_positions, running_sums

# fixed values: USD per 1,000 prompt / completion tokens, and the price of any other model
PRICES_PER_1K = {
    "gpt-4o-mini": ("0.00015", "0.00060"),
    "gpt-4o": ("0.00250", "0.01000"),
    "gpt-4.1-mini": ("0.00040", "0.00160"),
    "gpt-4.1": ("0.00200", "0.00800"),
    "gpt-4": ("0.03000", "0.06000"),
    "gpt-35-turbo": ("0.00050", "0.00150"),
}
FALLBACK_PRICE = ("0.00250", "0.01000")

DAILY_LIMIT_USD = 5.0
MAX_BUNDLE_RETRIES = 3
FAILURE_THRESHOLD = 5

_PRICE = "decimal(9,5)"
_MONEY = "decimal(20,8)"


def price_table(spark: SparkSession) -> DataFrame:
    """The default prices as a literal relation: its size is known to the optimizer, which broadcasts it."""
    rows = ", ".join(f"('{m}', {i}BD, {o}BD)" for m, (i, o) in PRICES_PER_1K.items())
    return spark.sql(
        f"select model, cast(i as {_PRICE}) as in_price, cast(o as {_PRICE}) as out_price from values {rows} as t(model, i, o)"
    )


def call_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Adds `cost` in USD, exact decimals. Unknown models get the fallback price.

    The join carries no hint: a price list within the broadcast threshold is broadcast, a longer one shuffled.
    """
    prices = prices if prices is not None else price_table(calls.sparkSession)

    def part(tokens: str, price: str, fallback: str) -> Column:
        return F.col(tokens).cast("decimal(14,0)") * F.coalesce(price, F.lit(fallback).cast(_PRICE))

    milli = part("prompt_tokens", "in_price", FALLBACK_PRICE[0]) + part("completion_tokens", "out_price", FALLBACK_PRICE[1])
    return calls.join(prices, "model", "left").select(
        *calls.columns, (milli * F.lit("0.001").cast("decimal(4,3)")).cast(_MONEY).alias("cost")
    )


def daily_spend(calls: DataFrame, ts: str = "ts", prices: DataFrame | None = None) -> DataFrame:
    costed = call_cost(calls, prices).withColumn("day", utc_day(F.col(ts)))
    return costed.groupBy("day").agg(F.sum("cost").alias("spent"), F.count("*").alias("n_calls"))


def budget_status(
    calls: DataFrame, limit_usd: float = DAILY_LIMIT_USD, ts: str = "ts", prices: DataFrame | None = None
) -> DataFrame:
    """Limit, spend and what is left (never negative) per UTC day, to six decimals."""
    spent = F.col("spent").cast("double")
    return daily_spend(calls, ts, prices).select(
        "day",
        F.lit(float(limit_usd)).alias("limit_usd"),
        round_exact(spent, 6).alias("spent_usd"),
        round_exact(F.greatest(F.lit(float(limit_usd)) - spent, F.lit(0.0)), 6).alias("remaining_usd"),
    )


def budget_admission(
    calls: DataFrame,
    limit_usd: float = DAILY_LIMIT_USD,
    ts: str = "ts",
    seq: str = "call_id",
    prices: DataFrame | None = None,
    cells: Cells | None = None,
) -> DataFrame:
    """Whether each call would have been let through by the daily cap.

    A call is refused once the spend recorded before it that day has reached the limit. Costs are not negative,
    so an exclusive running sum decides this without state: after the limit is reached every later sum is over it.
    """
    costed = call_cost(calls, prices).select(
        F.col(seq).alias("seq"), utc_day(F.col(ts)).alias("day"), F.unix_micros(F.col(ts)).alias("us"), "cost"
    )
    summed = running_sums(costed, ["day"], {"spent": F.col("cost")}, cells)
    return summed.select(
        F.col("seq").alias(seq), "day", "cost", ((F.col("spent") - F.col("cost")) < F.lit(str(limit_usd)).cast(_MONEY)).alias("allowed")
    )


def trailing_hits(hits: DataFrame, key: str, window_us: int, cells: Cells | None = None) -> DataFrame:
    """Hits of the same key in the closed window [t - W, t], per distinct instant of a key: `key, us, n, hits`.

    The count is a difference of two running counts, the second read by a marker at t - W. Simultaneous hits are
    merged first, so a burst is one row.
    """
    points = hits.groupBy(key, "us").agg(F.count("*").alias("n"))
    both = points.select(
        key,
        F.col("us").alias("at"),
        F.inline(
            F.array(
                F.struct((F.col("us") - window_us).alias("us"), F.lit(0).cast("bigint").alias("tie"), F.lit(0).cast("bigint").alias("w")),
                F.struct(F.col("us"), F.lit(1).cast("bigint").alias("tie"), F.col("n").alias("w")),
            )
        ),
    )
    seen = running_sums(both, [key], {"seen": F.col("w")}, cells, tie="tie")
    out = seen.groupBy(key, F.col("at").alias("us")).agg(
        F.max("w").alias("n"),
        (F.max(F.when(F.col("tie") == 1, F.col("seen"))) - F.max(F.when(F.col("tie") == 0, F.col("seen")))).alias("hits"),
    )
    return out


def failure_incidents(
    calls: DataFrame,
    keys: Sequence[str],
    ok: Column,
    threshold: int = FAILURE_THRESHOLD,
    cells: Cells | None = None,
) -> DataFrame:
    """Stretches of at least `threshold` consecutive failures: `keys, first_failure_us, opened_us, closed_us, n_failures`.

    An incident opens at its threshold-th failure and is closed by the next success (`closed_us` NULL: still open).
    Calls need `us` and `seq`.
    """
    runs = run_positions(calls.withColumn("_ok", ok), keys, restart="_ok", cells=cells)
    # a run starts at a success; its failures follow. Run 0 has no success in front.
    streak = F.col("run_pos") - F.when(F.col("run_id") > 0, 1).otherwise(0)
    failed = ~F.col("_ok")
    island = F.when(F.col("_ok"), F.col("run_id") - 1).otherwise(F.col("run_id"))
    grouped = runs.withColumn("streak", streak).groupBy(*keys, island.alias("island")).agg(
        F.min(F.when(failed, F.col("us"))).alias("first_failure_us"),
        F.max(F.when(failed & (F.col("streak") == threshold), F.col("us"))).alias("opened_us"),
        F.max(F.when(F.col("_ok"), F.col("us"))).alias("closed_us"),
        F.count_if(failed).alias("n_failures"),
    )
    return grouped.where(F.col("n_failures") >= threshold).drop("island")


def retry_outcomes(
    attempts: DataFrame,
    keys: Sequence[str],
    ok: Column,
    max_retries: int = MAX_BUNDLE_RETRIES,
    cells: Cells | None = None,
) -> DataFrame:
    """Adds `attempt` and `outcome` (ok / retry / dead_letter) to attempts with `us` and `seq`.

    The failure after `max_retries` retries goes to the dead letters and the count starts over, as it does
    after a success.
    """
    runs = run_positions(attempts.withColumn("_ok", ok), keys, restart="_ok", cells=cells)
    streak = F.col("run_pos") - F.when(F.col("run_id") > 0, 1).otherwise(0)
    attempt = F.when(F.col("_ok"), F.lit(0)).otherwise(F.pmod(streak - 1, F.lit(max_retries + 1)) + 1)
    outcome = F.when(F.col("_ok"), "ok").when(F.col("attempt") > max_retries, "dead_letter").otherwise("retry")
    return runs.withColumn("attempt", attempt.cast("bigint")).withColumn("outcome", outcome).drop("_ok", "run_id", "run_pos")


def dead_letters(outcomes: DataFrame) -> DataFrame:
    """The records to ship to the dead-letter table, with the reason and the attempts made."""
    return (
        outcomes.where("outcome = 'dead_letter'")
        .withColumn("reason", F.concat(F.lit("failed after "), (F.col("attempt") - 1).cast("string"), F.lit(" retries")))
        .drop("outcome")
    )


def safe_offsets(ledger: DataFrame) -> DataFrame:
    """Next offset to read per (topic, partition): the lowest unfinished one, else one past the highest."""
    return ledger.groupBy("topic", "part").agg(
        F.coalesce(F.min(F.when(~F.col("done"), F.col("off"))), F.max("off") + 1).alias("commit_offset")
    )


def safe_offsets_for_trace(ledger: DataFrame, trace_id: str) -> DataFrame:
    """What finishing one trace allows to commit: its own partitions only, its offsets taken as done.

    One aggregate: a partition is kept if it holds an offset of the trace. An unknown trace commits nothing.
    """
    mine = F.col("trace_id") == trace_id
    return (
        ledger.groupBy("topic", "part")
        .agg(
            F.coalesce(F.min(F.when(~F.col("done") & ~mine, F.col("off"))), F.max("off") + 1).alias("commit_offset"),
            F.max(mine).alias("touched"),
        )
        .where("touched")
        .drop("touched")
    )
