"""Parquet tables: raw logs by day, analyses by month, dead letters, embedding cache, evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise import schemas
from bundlewise.functions.responses import evidence_json
from bundlewise.functions.timestamps import iso_utc, month_key, utc_day
from bundlewise.operators.hooks import text_key
from bundlewise.sources.files import folders, remove


def _by_partition(rows: DataFrame, column: str) -> DataFrame:
    """Rows laid out for a partitioned write.

    The rebalance hint lets adaptive execution cut a busy partition into many files of the advisory size and
    gather small ones, whatever share of the rows one partition holds. Sorting by trace gives the files narrow
    min/max statistics for look-ups.
    """
    return rows.hint("rebalance", column).sortWithinPartitions(column, "trace_id")


def write_raw_logs(rows: DataFrame, path: str) -> None:
    _by_partition(rows, "day").write.mode("append").partitionBy("day").parquet(path)


def read_raw_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW_LOG).option("basePath", path).parquet(path)


def stored_answer(answered: DataFrame, run: str, key: str) -> DataFrame:
    """Answered bundles with their typed fields and `created_at` as rows of the analyses table.

    The run is part of the ids, so that an analysis repeated later is another row. `uid` has 128 bits; `id`, 64 bits of the
    same key, is what readers of one trace see, and `uid` settles rows in which it is equal by chance.
    """
    ident = [F.lit(run), F.col("trace_id"), F.col(key)]
    return answered.select(
        F.xxhash64(*ident).alias("id"),
        "trace_id",
        F.lit(0).alias("part"),
        "log_text",
        F.col("raw_text").alias("analysis"),
        "model",
        "prompt_version",
        "category",
        "root_cause",
        "next_step",
        evidence_json(F.col("evidence")).alias("evidence"),
        "confidence",
        "created_at",
        F.md5(F.to_json(F.struct(*[x.alias(f"k{i}") for i, x in enumerate(ident)]))).alias("uid"),
    )


def call_rows(answered: DataFrame, key: str) -> DataFrame:
    """The analyzer's calls with the tokens they used, as `daily_spend` and the latency statistics read them."""
    return answered.select(
        F.col(key).cast("string").alias("call_id"),
        "trace_id",
        F.col("created_at").alias("ts"),
        F.unix_micros("created_at").alias("us"),
        "model",
        "prompt_version",
        "prompt_tokens",
        "completion_tokens",
        "latency_s",
        "attempts",
        F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"),
        "error",
        utc_day(F.col("created_at")).alias("day"),
    )


def analysis_rows(analyses: DataFrame, created_at: str = "created_at") -> DataFrame:
    """Adds the month the table is partitioned by."""
    return analyses.withColumn("created_month", month_key(F.col(created_at)))


#: For tables that hold the texts of bundles: neighbours share most lines, which a long window finds where they lie side by side.
TEXTS = {"compression": "zstd"}
#: Rows that are stored in the order they come in are found by trace through bloom filters, as large as the file's traces need
#: (else a megabyte in each file, which is more than the texts).
IN_ORDER = {**TEXTS, "parquet.bloom.filter.enabled#trace_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def write_analyses(analyses: DataFrame, path: str, in_order: bool = False) -> None:
    """Append one batch; new months become new partitions by themselves.

    With `in_order` the rows are written by the tasks that make them: for a batch whose texts are far larger than its input and
    that falls into few months. They pass through no shuffle, and bundles stay beside those that share their lines.
    """
    if in_order:
        analysis_rows(analyses).write.mode("append").options(**IN_ORDER).partitionBy("created_month").parquet(path)
        return
    rows = _by_partition(analysis_rows(analyses), "created_month")
    rows.write.mode("append").partitionBy("created_month").parquet(path)


def append_analyses_table(analyses: DataFrame, table: str) -> None:
    """The same into a catalog table, whose months can be dropped as metadata."""
    rows = _by_partition(analysis_rows(analyses), "created_month")
    rows.write.mode("append").partitionBy("created_month").format("parquet").saveAsTable(table)


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """All versions of the table: columns added later are NULL in older files."""
    return spark.read.schema(schemas.ANALYSIS).option("mergeSchema", "true").parquet(path)


def drop_before(analyses: DataFrame, month: str) -> DataFrame:
    """Rows that survive retention; on the stored table the filter prunes whole partitions."""
    return analyses.where(F.col("created_month") >= month)


def drop_old_months(spark: SparkSession, table: str, month: str) -> list[str]:
    """Drop all partitions of a catalog table before `month`; no row is read. Returns the dropped months."""
    listed = [r[0].split("=", 1)[1] for r in spark.sql(f"show partitions {table}").collect()]
    old = sorted(m for m in listed if m < month)
    for m in old:
        spark.sql(f"alter table {table} drop if exists partition (created_month = '{m}')")
    return old


def drop_old_months_of_path(spark: SparkSession, path: str, month: str) -> list[str]:
    """Delete the folders of all months before `month` of a path table (also within the runs of committed tables).

    No row is read and no other month is touched. Returns the deleted months.
    """
    gone: set[str] = set()
    places = [path] + [f"{path}/{r}/{a}" for r in folders(spark, path) if r.startswith("run=") for a in folders(spark, f"{path}/{r}")]
    for place in places:
        for name in folders(spark, place):
            column, _, value = name.partition("=")
            if column == "created_month" and value < month and remove(spark, f"{place}/{name}"):
                gone.add(value)
    return sorted(gone)


def replace_months(rows: DataFrame, path: str) -> None:
    """Rewrite the months that occur in `rows` and leave all others as they are, e.g. after removing repeats."""
    laid = _by_partition(analysis_rows(rows.drop("created_month")), "created_month")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("created_month").parquet(path)


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """Newest analysis per trace; equal times are settled by the higher id, equal ids by the wider `uid` where there is one.

    Only (trace, time, id) is aggregated, combined before the shuffle, so a trace analysed very often does not pile up
    anywhere; the wide rows are then looked up. A row stored twice under one id counts once.
    """
    stamp = F.struct("created_at", "id", *[c for c in ("uid",) if c in analyses.columns])
    newest = analyses.groupBy(F.struct("trace_id").alias("_k")).agg(F.max(stamp).alias("_at"))
    keyed = analyses.withColumn("_k", F.struct("trace_id")).withColumn("_at", stamp)
    return keyed.join(newest, ["_k", "_at"], "left_semi").dropDuplicates(["_k", "_at"]).drop("_k", "_at")


def analysis_of(analyses: DataFrame, trace_id: str) -> DataFrame:
    """Newest analysis of one trace; the filter reaches the parquet scan."""
    hit = latest_analysis(analyses.where(F.col("trace_id") == trace_id))
    return hit.withColumn("created_at", iso_utc(F.col("created_at")))


def write_dead_letters(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def read_embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, text string, vector array<double>").parquet(path)


def append_embedding_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_embedding_table(rows: DataFrame, table: str, buckets: int = 200, path: str | None = None) -> None:
    """Append vectors to a catalog table bucketed by the key of (model, text), so that looking texts up moves no vector."""
    keyed = rows.select("model", "text", "vector").withColumn("text_key", text_key(F.col("model"), F.col("text")))
    # rows of a bucket meet in one task, so an append adds one file to each bucket
    writer = keyed.repartition(buckets, "text_key").write.mode("append").format("parquet").bucketBy(buckets, "text_key").sortBy("text_key")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_eval_cases(spark: SparkSession, path: str, case_id: str | None = None) -> DataFrame:
    """Evaluation cases, optionally only one; an unknown id is an error, as is an empty set of cases."""
    cases = spark.read.schema(schemas.EVAL_CASE).option("multiLine", "true").json(path)
    if case_id is None:
        return cases
    one = cases.where(F.col("id") == case_id)
    if one.isEmpty():
        raise ValueError(f"no such case: {case_id}")
    return one


def write_eval_results(cases: DataFrame, aggregate: DataFrame, path: str) -> None:
    """Per-case rows and the aggregate record as two JSON tables under one folder."""
    cases.write.mode("overwrite").json(f"{path}/cases")
    aggregate.write.mode("overwrite").json(f"{path}/aggregate")


def read_eval_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/cases"), spark.read.json(f"{path}/aggregate")
