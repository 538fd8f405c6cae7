"""Analysing bundles of a stream with bounded retries and a dead-letter table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.functions.responses import enrich, evidence_json
from bundlewise.operators.governance import MAX_BUNDLE_RETRIES
from bundlewise.operators.hooks import Analyzer, analyze_bundles
from bundlewise.operators.prompts import render_prompts

BUNDLE = ["trace_id", "first_us", "last_us", "first_seq", "last_seq", "n_logs", "reason", "log_text"]


class BundleWorker:
    """`foreachBatch` target. Every output goes to a folder named by the batch and is overwritten on replay, so a
    repeated micro-batch leaves no duplicates; a failed bundle is tried again with the next batch.
    """

    def __init__(
        self,
        root: str,
        prompts: DataFrame,
        make_analyzer: Callable[[], Analyzer],
        version: str = "v3",
        window_seconds: int = 60,
        max_retries: int = MAX_BUNDLE_RETRIES,
        pause: float = 1.0,
    ) -> None:
        if prompts.where(F.col("version") == version).isEmpty():
            raise ValueError(f"unknown prompt version: {version}")
        self.root = root
        self.prompts = prompts
        self.make_analyzer = make_analyzer
        self.version = version
        self.window_seconds = window_seconds
        self.max_retries = max_retries
        self.pause = pause

    def __call__(self, bundles: DataFrame, batch_id: int) -> None:
        spark = bundles.sparkSession
        todo = bundles.select(*BUNDLE).withColumn("retries", F.lit(0))
        waiting = self._read(spark, "retry", batch_id - 1)
        if waiting is not None:
            todo = todo.unionByName(waiting.select(*BUNDLE, "retries"))
        rendered, _ = render_prompts(todo, self.prompts, self.window_seconds, self.version)
        answered = analyze_bundles(rendered, self.make_analyzer, pause=self.pause)
        # written once, then read by the three outputs: the analyzer is not called again
        staged = self._path("answered", batch_id)
        answered.write.mode("overwrite").parquet(staged)
        answered = spark.read.schema(answered.schema).parquet(staged)

        failed = answered.where("error is not null").withColumn("attempt", F.col("retries") + 1)
        dead = F.col("attempt") > self.max_retries
        ok = answered.where("error is null").withColumn("f", enrich(F.col("raw_text"), F.col("prompt_version")))
        ok = ok.select(
            *BUNDLE, F.col("raw_text").alias("analysis"), "model", "prompt_version",
            "f.category", "f.root_cause", "f.next_step", evidence_json(F.col("f.evidence")).alias("evidence"), "f.confidence",
        )
        ok.write.mode("overwrite").parquet(self._path("analyses", batch_id))
        failed.where(~dead).select(*BUNDLE, F.col("attempt").alias("retries"), "error").write.mode("overwrite").parquet(
            self._path("retry", batch_id)
        )
        failed.where(dead).select(*BUNDLE, "retries", "error").write.mode("overwrite").parquet(self._path("dlq", batch_id))

    def drain(self, spark: SparkSession, after_batch: int) -> int:
        """After the stream has ended: repeat the waiting bundles until each is analysed or dead. Bounded by the
        retry limit. Returns the last batch number used."""
        batch = after_batch
        while True:
            waiting = self._read(spark, "retry", batch)
            if waiting is None or waiting.isEmpty():
                return batch
            batch += 1
            self(waiting.select(*BUNDLE).limit(0), batch)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """All batches of `analyses`, `retry` or `dlq`."""
        return spark.read.parquet(f"{self.root}/{name}")

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/batch_id={batch_id}"

    def _read(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame | None:
        try:
            return spark.read.parquet(self._path(name, batch_id))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # the first batch, or one without failures
                return None
            raise
