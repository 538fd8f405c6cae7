"""Bundling and analysis of a stream in one `foreachBatch` job whose tables change together.

Each micro-batch is stored once, then bundled by DataFrame scans: rows that are not due, and bundles that are still open,
are carried to the next batch in a state table. Nothing runs row by row in Python but the user's analyzer, and a trace
with very many rows is cut into cells like any ordered scan. All tables of a batch, the carried rows and the watermark
appear with one commit record, so a batch that is stopped and replayed counts once.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise import schemas
from bundlewise.functions.responses import enrich
from bundlewise.functions.timestamps import utc_day
from bundlewise.operators.bundles import BATCH_MAX, IDLE_SECONDS
from bundlewise.operators.correlate import bundle_line
from bundlewise.operators.governance import MAX_BUNDLE_RETRIES
from bundlewise.operators.hooks import Analyzer, analyze_bundles
from bundlewise.operators.ordered import run_positions
from bundlewise.operators.prompts import render_prompts
from bundlewise.session import empty
from bundlewise.sources.commits import Commit, CommittedTables
from bundlewise.sources.files import remove
from bundlewise.sources.logs import raw_log_rows
from bundlewise.sources.stores import analysis_rows, call_rows, stored_answer

log = logging.getLogger(__name__)

EVENT, PROCESSING = "event", "processing"

# a row that waits or lies in an open bundle; `at` is the time that orders it: its own, or that of its arrival
CARRIED = "trace_id string, at bigint, seq bigint, us bigint, line string, topic string, `partition` int, `offset` bigint, value string"
RECORD = "struct<at: bigint, seq: bigint, us: bigint, line: string, topic: string, `partition`: int, `offset`: bigint, value: string>"
BUNDLE = "bundle_id string, trace_id string, first_us bigint, last_us bigint, first_seq bigint, last_seq bigint, n_logs bigint, reason string, log_text string"
WAITING = f"{BUNDLE}, items array<{RECORD}>, retries int"
REJECTED = "topic string, `partition` int, `offset` bigint, value string, reject_reason string"
DEAD = "bundle_id string, trace_id string, topic string, `partition` int, `offset` bigint, value string, retries int, error string"

_ITEM = ["at", "seq", "us", "line", "topic", "partition", "offset", "value"]


def _names(ddl: str) -> list[str]:
    return [c.split()[0].strip("`") for c in ddl.split(", ")]


@dataclass
class _Step:
    """What one batch works on."""

    run: str
    attempt: str
    batch_id: int
    closing: bool
    before: Commit | None
    tables: list[str]
    counters: dict[str, int]


class StreamBundler:
    """`foreachBatch` target for decoded messages (`decoded_stream`): tables `raw_logs`, `rejected` and `bundles`.

    mode `event`: rows wait until the watermark (latest time seen less `delay_seconds`) has passed them and are taken in
    (time, seq) order; a bundle is idle once the watermark is `idle_seconds` past its last row. Rows behind the watermark
    of the batch before are rejected as late (their raw log is stored all the same). Bundles do not depend on how the
    input is cut into batches.
    mode `processing`: rows count in the order of arrival, and a bundle is idle once the clock is `idle_seconds` past the
    arrival of its last row. Where no input comes, `tick` lets the clock go on.

    Storing raw logs is best effort: a failure is logged, counted as `raw_logs_failed`, and the batch goes on.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        name: str = "stream",
        mode: str = EVENT,
        idle_seconds: int = IDLE_SECONDS,
        batch_max: int = BATCH_MAX,
        delay_seconds: int | None = None,
        clock: Callable[[], float] = time.time,
    ) -> None:
        if mode not in (EVENT, PROCESSING):
            raise ValueError(f"unknown mode: {mode}")
        self.tables = CommittedTables(spark, root)
        self.spark, self.name, self.mode = spark, name, mode
        self.idle_us, self.batch_max = idle_seconds * 1_000_000, batch_max
        self.delay_us = (idle_seconds if delay_seconds is None else delay_seconds) * 1_000_000
        self.clock = clock
        self._last = self.tables.last(name)

    def __call__(self, records: DataFrame, batch_id: int) -> None:
        """One micro-batch; one that was committed before is left alone."""
        if self._last is None or batch_id > self._last.batch_id:
            self._step(records, batch_id, f"{self.name}-{batch_id}")

    def tick(self) -> None:
        """A step without input: in `processing` mode bundles that have become idle are closed, and retries go on."""
        self._quiet(False)

    def drain(self) -> None:
        """After the stream has ended: close what is open, and repeat until nothing waits (retries are bounded)."""
        self._quiet(True)
        while self._waits():
            self._quiet(True)

    def counters(self) -> DataFrame:
        """The counters of every committed batch: `run, seq, name, n`."""
        mine = self.tables.commits().where(F.col("stream") == self.name)
        return mine.select("run", "seq", "committed_at", F.explode("counters").alias("name", "n"))

    # ---- one step -------------------------------------------------------------------------------------------

    def _quiet(self, closing: bool) -> None:
        seq = self._last.seq + 1 if self._last else 0
        self._step(None, self._last.batch_id if self._last else -1, f"{self.name}-quiet-{seq}", closing)

    def _step(self, records: DataFrame | None, batch_id: int, run: str, closing: bool = False) -> None:
        step = _Step(run, self.tables.new_attempt(), batch_id, closing, self._last, [], {})
        staged: list[str] = []
        rows, watermark = self._state("_carried", CARRIED), self._last.watermark_us if self._last else None
        if records is not None:
            arrived = self._staged(records, "_arrived", step, staged)
            good = F.col("reject_reason").isNull()
            late = F.lit(False)
            if self.mode == EVENT and watermark is not None:
                late = F.unix_micros("ts") < watermark
            seen = arrived.agg(
                F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"),
                F.count_if(good & late).alias("late"), F.max(F.when(good, F.unix_micros("ts"))).alias("us"),
            ).first()
            step.counters |= {"logs_ingested": seen["accepted"], "logs_rejected": seen["rejected"], "logs_late": seen["late"]}
            if self.mode == EVENT and seen["us"] is not None:
                watermark = max(seen["us"] - self.delay_us, watermark if watermark is not None else seen["us"] - self.delay_us)
            self._store_logs(arrived, good, late, step)
            new = arrived.where(good & ~late).withColumn("us", F.unix_micros("ts")).withColumn("line", bundle_line())
            at = F.col("us") if self.mode == EVENT else F.lit(int(self.clock() * 1_000_000))
            rows = rows.unionByName(new.withColumn("at", at).select(*_names(CARRIED)))
        now = watermark if self.mode == EVENT else int(self.clock() * 1_000_000)
        self._bundle(rows, now, step, staged)
        step.counters["open_rows"] = self.tables.read_attempt(CARRIED, "_carried", run, step.attempt).count()
        done = Commit(self.name, run, step.attempt, self._last.seq + 1 if self._last else 0, batch_id, tuple(step.tables), watermark, step.counters)
        self.tables.commit(done)
        self._last = done
        # the state of the batch before and what this one only staged are not read again
        for path in staged + ([self.tables.path(t, step.before.run, step.before.attempt) for t in ("_carried", "_waiting")] if step.before else []):
            remove(self.spark, path)

    def _state(self, table: str, schema: str) -> DataFrame:
        if self._last is None or table not in self._last.tables:
            return empty(self.spark, schema)
        return self.tables.read_attempt(schema, table, self._last.run, self._last.attempt)

    def _staged(self, rows: DataFrame, table: str, step: _Step, staged: list[str]) -> DataFrame:
        """Rows written once and read by several outputs; removed after the commit."""
        path = self.tables.path(table, step.run, step.attempt)
        rows.write.mode("overwrite").parquet(path)
        staged.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _write(self, rows: DataFrame, table: str, step: _Step, by: str | None = None) -> None:
        self.tables.write(rows, table, step.run, step.attempt, by)
        step.tables.append(table)

    def _store_logs(self, arrived: DataFrame, good: Column, late: Column, step: _Step) -> None:
        try:
            self._write(raw_log_rows(arrived.where(good), F.col("ts")), "raw_logs", step, "day")
        except (PySparkException, Py4JJavaError):
            step.counters["raw_logs_failed"] = 1
            log.exception("raw logs of %s not saved; going on", step.run)
        reason = F.when(good & late, F.lit("late")).otherwise(F.col("reject_reason"))
        if step.counters["logs_rejected"] or step.counters["logs_late"]:
            refused = arrived.where(~good | late).withColumn("reject_reason", reason)
            self._write(refused.select(*_names(REJECTED)), "rejected", step)

    def _bundle(self, rows: DataFrame, now: int | None, step: _Step, staged: list[str]) -> None:
        """Cut the due rows into bundles; open ones and rows not yet due are carried on."""
        due = F.lit(True) if step.closing or self.mode == PROCESSING else (F.col("at") < now if now is not None else F.lit(False))
        placed = run_positions(rows.where(due), ["trace_id"], gap_us=self.idle_us, us="at")
        placed = placed.withColumn("bundle", F.expr(f"(run_pos - 1) div {self.batch_max}"))
        # at most batch_max rows meet in one group
        groups = placed.groupBy("trace_id", "run_id", "bundle").agg(F.array_sort(F.collect_list(F.struct(*_ITEM))).alias("items"))
        n = F.size("items")
        idle = F.lit(step.closing) if now is None or step.closing else F.lit(now) - F.element_at("items", -1)["at"] >= self.idle_us
        # a shorter bundle that another of its trace follows is idle by this rule too: the rows between are due
        reason = F.when(n >= self.batch_max, "batch_full").when(idle, "idle")
        groups = groups.select(
            F.concat(F.lit(f"{step.run}-"), F.monotonically_increasing_id().cast("string")).alias("bundle_id"),
            "trace_id",
            F.array_min("items.us").alias("first_us"),
            F.array_max("items.us").alias("last_us"),
            F.col("items")[0]["seq"].alias("first_seq"),
            F.element_at("items", -1)["seq"].alias("last_seq"),
            F.size("items").cast("bigint").alias("n_logs"),
            reason.alias("reason"),
            F.array_join("items.line", "\n").alias("log_text"),
            "items",
        )
        groups = self._staged(groups, "_groups", step, staged)
        left = groups.where("reason is null").select("trace_id", F.inline("items")).select(*_names(CARRIED))
        self._write(left.unionByName(rows.where(~due).select(*_names(CARRIED))), "_carried", step)
        self._handle(groups.where("reason is not null"), step, staged)

    def _handle(self, closed: DataFrame, step: _Step, staged: list[str]) -> None:
        self._write(closed.drop("items"), "bundles", step)

    def _waits(self) -> bool:
        return bool(self._last and self._last.counters.get("open_rows"))

    def bundles(self) -> DataFrame:
        return self.tables.read("bundles", BUNDLE).drop("run")

    def raw_logs(self) -> DataFrame:
        return self.tables.read("raw_logs", schemas.RAW_LOG).drop("run")

    def rejected(self) -> DataFrame:
        return self.tables.read("rejected", REJECTED).drop("run")


class TriageStream(StreamBundler):
    """The whole job on a stream: `raw_logs`, `rejected`, `analyses`, `calls` and `dead_letters`.

    A bundle whose analysis fails waits for the next step, up to `max_retries` times; then its original records go to
    the dead letters, one row each. `analyses` has the columns of the batch job's table, so all readers of it apply.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        prompts: DataFrame,
        make_analyzer: Callable[[], Analyzer],
        version: str = "v3",
        window_seconds: int = 60,
        max_retries: int = MAX_BUNDLE_RETRIES,
        pause: float = 1.0,
        parallelism: int | None = None,
        created_at: Column | None = None,
        **bundling,
    ) -> None:
        if prompts.where(F.col("version") == version).isEmpty():
            raise ValueError(f"unknown prompt version: {version}")
        super().__init__(spark, root, **bundling)
        self.prompts, self.make_analyzer, self.version = prompts, make_analyzer, version
        self.window_seconds, self.max_retries = window_seconds, max_retries
        self.pause, self.parallelism = pause, parallelism
        self.created_at = F.current_timestamp() if created_at is None else created_at

    def _handle(self, closed: DataFrame, step: _Step, staged: list[str]) -> None:
        # both sides are stored tables, so a bundle keeps its id however often it is read
        todo = closed.withColumn("retries", F.lit(0)).unionByName(self._state("_waiting", WAITING))
        asked, _ = render_prompts(todo.drop("items"), self.prompts, self.window_seconds, self.version)
        # written once: the analyzer is called once per bundle, whatever reads its answers
        answered = self._staged(analyze_bundles(asked, self.make_analyzer, pause=self.pause, parallelism=self.parallelism), "_answered", step, staged)
        answered = answered.withColumn("created_at", self.created_at)
        failed, dead = F.col("error").isNotNull(), F.col("retries") >= self.max_retries
        seen = answered.agg(
            F.count("*").alias("n"), F.count_if(~failed).alias("ok"), F.count_if(failed & ~dead).alias("again"), F.count_if(failed & dead).alias("dead"),
        ).first()
        step.counters |= {"windows_correlated": seen["n"], "calls_ok": seen["ok"], "calls_error": seen["again"] + seen["dead"],
                          "bundle_retries": seen["again"], "bundles_dlq": seen["dead"]}
        if not seen["n"]:
            return
        self._write(call_rows(answered, "bundle_id"), "calls", step, "day")
        if seen["ok"]:
            ok = answered.where(~failed).withColumn("f", enrich(F.col("raw_text"), F.col("prompt_version"))).select(*answered.columns, "f.*")
            self._write(analysis_rows(stored_answer(ok, step.run, "bundle_id")), "analyses", step, "created_month")
        if seen["again"] or seen["dead"]:
            # failed bundles get their records back from the staged rows
            lost = answered.where(failed).select("bundle_id", "error", dead.alias("dead"))
            whole = todo.join(lost, "bundle_id")
            if seen["again"]:
                self._write(whole.where("not dead").withColumn("retries", F.col("retries") + 1).select(*_names(BUNDLE), "items", "retries"), "_waiting", step)
            if seen["dead"]:
                shipped = whole.where("dead").select("bundle_id", "trace_id", "retries", "error", F.inline("items"))
                self._write(shipped.select(*_names(DEAD)), "dead_letters", step)

    def _waits(self) -> bool:
        return super()._waits() or bool(self._last and self._last.counters.get("bundle_retries"))

    def analyses(self) -> DataFrame:
        return self.tables.read("analyses", schemas.ANALYSIS).drop("run")

    def calls(self) -> DataFrame:
        return self.tables.read("calls", schemas.CALL).drop("run")

    def dead_letters(self) -> DataFrame:
        return self.tables.read("dead_letters", DEAD).drop("run")


def run_available(messages: DataFrame, target: StreamBundler, checkpoint: str, drain: bool = True) -> None:
    """Feed all available input of a decoded stream to the target, then close what is open."""
    query = messages.writeStream.foreachBatch(target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if drain:
        target.drain()
