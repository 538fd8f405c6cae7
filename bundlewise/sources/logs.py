"""Reading, validating and normalising log records from files and streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise import schemas
from bundlewise.functions.timestamps import parse_ts, utc_day

KNOWN_KEYS = ("trace_id", "level", "message", "timestamp")
MAX_LOGS_PER_REQUEST = 5000


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per line as `value`; nothing is decoded yet, so bad lines can be rejected with a reason."""
    return spark.read.text(path)


def stream_json_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """Broker source with the columns of `schemas.MESSAGE`; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )
    return raw.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to the four known fields and `payload`, the JSON of all other keys (NULL when there are none).

    An explicit null counts as missing. Types inside the payload are kept. `is_object` is false for malformed
    text and for JSON that is not an object.
    """
    record = F.from_json(F.col(value), "map<string,variant>")
    rest = F.map_filter(F.col("_record"), lambda k, v: ~k.isin(*KNOWN_KEYS))

    def text_of(key: str) -> Column:
        got = F.try_element_at(F.col("_record"), F.lit(key))
        return got.cast("string").alias(key)

    return (
        messages.withColumn("_record", record)
        .select(
            *messages.columns,
            F.col("_record").isNotNull().alias("is_object"),
            text_of("timestamp"),
            text_of("level"),
            text_of("message"),
            text_of("trace_id"),
            F.when(F.size(rest) > 0, F.to_json(rest)).alias("payload"),
        )
    )


def reject_reason(is_object: Column | None = None, instant: Column | None = None) -> Column:
    """Why a record cannot be stored; NULL for a good one. Empty trace ids and timestamps count as missing.

    `instant` is the parsed timestamp, where there is one already.
    """
    ts = F.col("timestamp")
    reason = F.when(F.coalesce(F.col("trace_id"), F.lit("")) == "", "missing trace_id")
    if is_object is not None:
        reason = F.when(~is_object, "not a json object").when(F.coalesce(F.col("trace_id"), F.lit("")) == "", "missing trace_id")
    return reason.when(F.coalesce(ts, F.lit("")) == "", "missing timestamp").when(
        (parse_ts(ts) if instant is None else instant).isNull(), "unreadable timestamp"
    )


def validate(logs: DataFrame, instant: Column | None = None) -> DataFrame:
    """Adds `reject_reason`; one bad record never fails the job."""
    flag = F.col("is_object") if "is_object" in logs.columns else None
    return logs.withColumn("reject_reason", reject_reason(flag, instant))


def split_valid(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    checked = validate(logs)
    return checked.where("reject_reason is null").drop("reject_reason"), checked.where("reject_reason is not null")


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources as one frame with a `source` label; columns a source lacks are NULL."""
    out: DataFrame | None = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources given")
    return out


def raw_log_rows(logs: DataFrame, instant: Column | None = None) -> DataFrame:
    """Storable rows: bad ones dropped, defaults filled, timestamp typed (`instant`, where it was parsed already), partition day added."""
    ts = parse_ts(F.col("timestamp")) if instant is None else instant
    has = set(logs.columns)
    return (
        logs.where((F.col("trace_id") != "") & (F.col("timestamp") != ""))
        .withColumn("ts", ts)
        .where(F.col("ts").isNotNull())
        .select(
            "seq",
            "trace_id",
            F.coalesce("level", F.lit("INFO")).alias("level"),
            F.coalesce("message", F.lit("")).alias("message"),
            "ts",
            (F.col("payload") if "payload" in has else F.lit(None).cast("string")).alias("payload"),
            (F.col("source") if "source" in has else F.lit(None).cast("string")).alias("source"),
            utc_day(F.col("ts")).alias("day"),
        )
    )


def client_key(forwarded: Column, host: Column) -> Column:
    """First hop of a forwarding header, else the peer host, else `unknown`; an empty header counts as absent."""
    first = F.trim(F.split(forwarded, ",")[0])
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(F.coalesce(host, F.lit("unknown")))


def request_sizes(logs: DataFrame, request: str, limit: int = MAX_LOGS_PER_REQUEST) -> DataFrame:
    """Logs per request and whether the request is refused as too large or empty of logs to analyse."""
    return logs.groupBy(request).agg(F.count("*").alias("n_logs")).withColumn("is_oversize", F.col("n_logs") > limit)


def within_request_limit(logs: DataFrame, request: str, limit: int = MAX_LOGS_PER_REQUEST) -> DataFrame:
    """Logs of requests of accepted size. The refused ids are few by nature: each stands for more than `limit` rows."""
    refused = request_sizes(logs, request, limit).where("is_oversize").select(request)
    return logs.join(refused, request, "left_anti")


def request_logs(requests: DataFrame, limit: int = MAX_LOGS_PER_REQUEST) -> tuple[DataFrame, DataFrame]:
    """(logs, refused) of batch requests with `request_id, window_seconds, logs`.

    A request without logs, with more than `limit`, or with a log that lacks its timestamp, message or trace id
    is refused as a whole. A missing level is INFO. `seq` is the position in the request.
    """
    incomplete = F.exists(
        "logs", lambda e: e["timestamp"].isNull() | e["message"].isNull() | e["trace_id"].isNull()
    )
    n = F.coalesce(F.size("logs"), F.lit(0))
    checked = requests.withColumn(
        "refused",
        F.when(n < 1, "no logs").when(n > limit, f"too many logs (max {limit})").when(incomplete, "incomplete log"),
    )
    logs = (
        checked.where("refused is null")
        .select("request_id", "window_seconds", F.posexplode("logs").alias("seq", "e"))
        .select(
            "request_id",
            "window_seconds",
            F.col("seq").cast("bigint").alias("seq"),
            "e.trace_id",
            "e.timestamp",
            F.coalesce("e.level", F.lit("INFO")).alias("level"),
            "e.message",
        )
    )
    return logs, checked.where("refused is not null").select("request_id", "refused")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REQUEST).json(path)
