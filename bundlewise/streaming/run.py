"""Running a streaming query to the end of its input, and draining it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bundlewise.session import checkpoint_root

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DRAIN_KEY = "\x00drain"


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process all available input into parquet under `folder` and read the result back."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/out")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_and_drain(
    stream: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, last_us: int, margin_us: int, key: str
) -> DataFrame:
    """Run `build(stream)` to the end of its input, then close what is still open by event time.

    A stream that ends never closes its last windows: nothing moves the watermark past them. So a second, at
    first empty file source is united with the stream; after the input is used up it receives one record
    `margin_us` past the last time, with `DRAIN_KEY` in `key`, and the query resumes from its checkpoint.
    The record must be filtered from the output.
    """
    spark = stream.sparkSession
    late = F.timestamp_micros(F.lit(last_us + margin_us))
    row = spark.range(1).select(
        *[
            (late if f.name == "ts" else F.lit(DRAIN_KEY) if f.name == key else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in stream.schema.fields
        ]
    )
    row.limit(0).write.mode("overwrite").parquet(f"{folder}/drain")

    def drained() -> DataFrame:
        return build(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{folder}/drain")))

    run_to_end(drained(), folder)
    row.write.mode("append").parquet(f"{folder}/drain")
    return run_to_end(drained(), folder)


def open_buffers(query: StreamingQuery) -> int:
    """Rows held in state by the last finished batch, from the query's own progress."""
    progress = query.lastProgress
    return sum(op.numRowsTotal for op in progress.stateOperators) if progress else 0


def with_state_store(spark: SparkSession) -> None:
    """State in RocksDB: larger than memory, checkpointed with the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
