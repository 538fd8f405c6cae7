"""Stateful count-or-idle bundling per trace on a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bundlewise.operators.bundles import BATCH_MAX, IDLE_SECONDS
from bundlewise.operators.correlate import bundle_line
from bundlewise.streaming.run import DRAIN_KEY, with_state_store

ROW = "us bigint, seq bigint, line string, buffered boolean"
OUTPUT = (
    "trace_id string, first_us bigint, last_us bigint, first_seq bigint, last_seq bigint, "
    "n_logs bigint, reason string, log_text string"
)
Bundle = Row(*[c.split()[0] for c in OUTPUT.split(", ")])


class Bundler(StatefulProcessor):
    """Buffers the rows of a trace and flushes on count or on idle time.

    `hold`: rows wait until the watermark has passed them and are then taken in (us, seq) order, so that the
    bundles do not depend on how the input was cut into micro-batches. Without it rows count as they arrive.
    State per trace is the open bundle (fewer than `batch_max` rows) and the rows still waiting, which span no
    more than the watermark delay.
    """

    def __init__(self, idle_us: int, batch_max: int, hold: bool) -> None:
        self.idle_us = idle_us
        self.batch_max = batch_max
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROW)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] == DRAIN_KEY:
            for _ in rows:
                pass
            return
        arrived = [(r.us, r.seq, r.line) for r in rows]
        if self.hold:
            # waiting rows are only appended here; they are read once, when the watermark has passed the first
            self.rows.appendList([(*r, False) for r in arrived])
            self._wake(min(arrived)[0])
        else:
            yield from self._advance(key, arrived, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _advance(self, key, arrived: list[tuple], watermark_us: int) -> Iterator[Row]:
        held = [tuple(r) for r in self.rows.get()]
        buffer = [r[:3] for r in held if r[3]]
        waiting = sorted([r[:3] for r in held if not r[3]] + arrived, key=lambda r: r[:2])
        # a row at the watermark may still be followed by one of the same instant
        due = len(waiting)
        if self.hold:
            due = next((i for i, r in enumerate(waiting) if r[0] >= watermark_us), due)
        done: list[tuple[str, list[tuple]]] = []
        for row in waiting[:due]:
            if buffer and row[0] - buffer[-1][0] >= self.idle_us:
                done.append(("idle", buffer))
                buffer = []
            buffer.append(row)
            if len(buffer) >= self.batch_max:
                done.append(("batch_full", buffer))
                buffer = []
        # nothing older than the watermark can still arrive, so an old enough buffer is closed
        if buffer and watermark_us - buffer[-1][0] >= self.idle_us:
            done.append(("idle", buffer))
            buffer = []
        if due or done:
            self._keep(buffer, waiting[due:], bool(held))
        if waiting[due:]:
            self._wake(waiting[due][0])
        if buffer:
            self._wake(buffer[-1][0] + self.idle_us)
        for reason, b in done:
            text = "\n".join(r[2] for r in b)
            yield Bundle(key[0], b[0][0], b[-1][0], b[0][1], b[-1][1], len(b), reason, text)

    def _keep(self, buffer: list[tuple], waiting: list[tuple], stored: bool) -> None:
        left = [(*r, True) for r in buffer] + [(*r, False) for r in waiting]
        if left:
            self.rows.put(left)
        elif stored:
            self.rows.clear()

    def _wake(self, us: int) -> None:
        """Timer at the first whole millisecond past `us`; one that fires in vain changes nothing."""
        self.handle.registerTimer(us // 1000 + 1)


def bundle_stream(
    logs: DataFrame,
    idle_seconds: int = IDLE_SECONDS,
    batch_max: int = BATCH_MAX,
    delay: str | None = None,
    hold: bool = True,
) -> DataFrame:
    """Bundles of a stream of (trace_id, seq, ts, timestamp, level, message).

    Rows later than the watermark delay (default: the idle time) are dropped by the engine and counted in the
    query progress.
    """
    with_state_store(logs.sparkSession)
    rows = logs.withWatermark("ts", delay or f"{idle_seconds} seconds").select(
        "trace_id",
        "ts",
        F.unix_micros("ts").alias("us"),
        "seq",
        bundle_line().alias("line"),
    )
    return rows.groupBy("trace_id").transformWithState(
        Bundler(idle_seconds * 1_000_000, batch_max, hold), OUTPUT, "append", "EventTime"
    )
