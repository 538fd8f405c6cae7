"""From broker-like messages to event-time log records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlewise.functions.timestamps import parse_ts
from bundlewise.sources.logs import decode, validate


def decoded_stream(messages: DataFrame) -> DataFrame:
    """Messages with decoded fields, event time `ts`, ordinal `seq` and `reject_reason`."""
    records = decode(messages).withColumn("ts", parse_ts(F.col("timestamp")))
    return validate(records, F.col("ts")).withColumn("seq", F.col("offset"))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject_reason is null").drop("reject_reason", "is_object")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject_reason is not null")
