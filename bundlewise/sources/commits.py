"""Several Parquet tables that change together: the rows of a run count once its commit record is written.

A run writes each table into folders of its own attempt, then one commit record names the run, the attempt and the tables.
Readers take the newest committed attempt of each run and nothing else, so a job that stops half-way, is repeated, or is
replayed by a stream leaves every table exact. A run repeated under the same name replaces its rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.sources.files import exists, folders, remove

COMMIT = (
    "stream string, run string, attempt string, seq bigint, batch_id bigint, tables array<string>, "
    "watermark_us bigint, counters map<string,bigint>, committed_at timestamp"
)


@dataclass(frozen=True)
class Commit:
    """One record: `seq` rises by one with each commit of a stream (or of the batch jobs, whose stream is '')."""

    stream: str
    run: str
    attempt: str
    seq: int
    batch_id: int = -1
    tables: tuple[str, ...] = ()
    watermark_us: int | None = None
    counters: Mapping[str, int] = field(default_factory=dict)


class CommittedTables:
    """Tables below `root`. One writer per stream name at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def new_attempt(self) -> str:
        return uuid.uuid4().hex

    def path(self, table: str, run: str, attempt: str) -> str:
        return f"{self.root}/{table}/run={run}/attempt={attempt}"

    def write(self, rows: DataFrame, table: str, run: str, attempt: str, by: str | None = None, in_order: Mapping[str, str] | None = None) -> None:
        """Rows of one attempt, optionally in partitions; not visible before the commit.

        With `in_order`, writer options, they are written by the tasks that make them, see `stores.write_analyses`.
        """
        if in_order is not None:
            rows.write.mode("overwrite").options(**in_order).partitionBy(*[by] if by else []).parquet(self.path(table, run, attempt))
            return
        if by is None:
            rows.write.mode("overwrite").parquet(self.path(table, run, attempt))
            return
        # the rebalance hint cuts a busy partition into files of the advisory size and gathers small ones
        laid = rows.hint("rebalance", by).sortWithinPartitions(by, "trace_id")
        laid.write.mode("overwrite").partitionBy(by).parquet(self.path(table, run, attempt))

    def read_attempt(self, schema: str, table: str, run: str, attempt: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table, run, attempt))

    def commit(self, record: Commit) -> None:
        """One record in one file: it is there as a whole or not at all."""
        row = (
            record.stream, record.run, record.attempt, record.seq, record.batch_id, list(record.tables),
            record.watermark_us, {k: int(v) for k, v in record.counters.items()},
        )
        names = COMMIT.rsplit(", committed_at", 1)[0]
        made = self.spark.createDataFrame([row], names).withColumn("committed_at", F.current_timestamp())
        made.coalesce(1).write.mode("append").parquet(f"{self.root}/_commits")

    def commits(self) -> DataFrame:
        """All commit records; empty where nothing was committed."""
        if not exists(self.spark, f"{self.root}/_commits"):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).parquet(f"{self.root}/_commits")

    def last(self, stream: str) -> Commit | None:
        """The newest commit of a stream: one row is fetched."""
        row = self.commits().where(F.col("stream") == stream).orderBy(F.desc("seq")).first()
        if row is None:
            return None
        return Commit(row.stream, row.run, row.attempt, row.seq, row.batch_id, tuple(row.tables), row.watermark_us, row.counters)

    def current(self, table: str) -> DataFrame:
        """`run, attempt`: the newest committed attempt of each run that wrote this table."""
        newest = self.commits().groupBy("stream", "run").agg(F.max_by(F.struct("attempt", "tables"), "seq").alias("c"))
        return newest.where(F.array_position("c.tables", table) > 0).select("run", F.col("c.attempt").alias("attempt"))

    def read(self, table: str, schema: str) -> DataFrame:
        """The committed rows of a table, with its columns in `schema` and the run they came from.

        Runs are folders, so the semi join with the commit records (one small row per run) prunes whole folders.
        """
        kinds = f"{schema}, run string, attempt string"
        if not exists(self.spark, f"{self.root}/{table}"):
            return self.spark.createDataFrame([], kinds).drop("attempt")
        rows = self.spark.read.schema(kinds).option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")
        return rows.join(self.current(table), ["run", "attempt"], "left_semi").drop("attempt")

    def vacuum(self, table: str, running: frozenset[str] = frozenset()) -> int:
        """Delete the attempts of a table that no reader takes; `running` names runs that are being written. Returns how many."""
        kept = {(r.run, r.attempt) for r in self.current(table).toLocalIterator()}
        gone = 0
        for run in folders(self.spark, f"{self.root}/{table}"):
            name = run.split("=", 1)[-1]
            for attempt in folders(self.spark, f"{self.root}/{table}/{run}"):
                if name not in running and (name, attempt.split("=", 1)[-1]) not in kept:
                    gone += remove(self.spark, f"{self.root}/{table}/{run}/{attempt}")
        return gone
