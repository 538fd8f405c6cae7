"""The engine's inputs (logs, calls, answers, ledgers, runs, …) as views over the given tables.

Each view is a projection or one aggregate of a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.session import prepare

US = "unix_micros(cast(ts as timestamp))"
ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"

LOG_FIELDS = [
    "event_id as seq",
    f"case when event_id%97=0 then null else concat('u',user_id,'-',{US} div 3600000000) end as trace_id",
    f"case when event_id%89=0 then 'not-a-time' else {ISO} end as timestamp",
    "case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then null else 'INFO' end as level",
    "concat(event_type,' ',props) as message",
    "case when event_id%3=0 then 'http' else 'kafka' end as source",
]

CALL_FIELDS = [
    "event_id as call_id",
    "event_id as seq",
    "cast(ts as timestamp) as ts",
    f"{US} as us",
    "concat('svc',user_id%5) as service",
    "case user_id%7 when 0 then 'gpt-4o-mini' when 1 then 'gpt-4o' when 2 then 'gpt-4.1-mini' when 3 then 'gpt-4.1' "
    "when 4 then 'gpt-4' when 5 then 'gpt-35-turbo' else 'custom' end as model",
    "cast(floor(value*10) as bigint) as prompt_tokens",
    "cast(floor(value*4) as bigint) as completion_tokens",
    "case when event_type='error' then 'error' else 'ok' end as status",
    "value/10 as latency_s",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(table(spark, sf_dir, "events"))


def logs_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(*LOG_FIELDS)


def messages_of(events: DataFrame) -> DataFrame:
    """Broker-like messages: JSON text with an extra key, some truncated and some not objects."""
    record = "to_json(named_struct('timestamp', timestamp, 'level', level, 'message', message, 'trace_id', trace_id, 'user', user_id))"
    return events.selectExpr(*LOG_FIELDS, "user_id").selectExpr(
        "'app.logs' as topic",
        "cast(user_id % 8 as int) as partition",
        "seq as offset",
        f"case when seq%101=0 then substring({record},1,20) when seq%103=0 then '[1, 2]' else {record} end as value",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*CALL_FIELDS)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers in three wordings; the cause is the whole text of a document on one line, so all answers differ."""
    cat = "case doc_id%5 when 0 then 'db' when 1 then ' Auth ' when 2 then 'cache' when 3 then 'disk' else 'other' end"
    conf = "case when n_chars%3=0 then 'High' when n_chars%3=1 then 'low' else 'medium' end"
    cause = r"trim(regexp_replace(coalesce(text, ''), r'[ \t\n\r\f\x0b\x1c-\x1e\x{85}\x{2028}\x{2029}]+', ' '))"
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("doc_id", f"{cat} as cat", f"{conf} as conf", f"{cause} as cause")
        .selectExpr("*", "to_json(named_struct('root_cause', cause)) as boxed")
        .selectExpr(
            "doc_id",
            "concat('v',doc_id%3+1) as version",
            """case when doc_id%13=0 then 'not parseable'
               when doc_id%3=1 then concat('Category :  ',cat,chr(10),'root_cause: ',cause,chr(10),'noise line',chr(10),
                 'evidence: ',case when doc_id%4<2 then 'a, b' else '["a","b"]' end,chr(10),'confidence: ',conf)
               when doc_id%3=2 then concat('{"category":"',cat,'",',substring(boxed,2,length(boxed)-2),',"evidence":',
                 case doc_id%4 when 0 then '["a","b"]' when 1 then '"a, b"' when 2 then '[]' else '5' end,
                 ',"confidence":',case when doc_id%5=0 then '3' else concat('"',conf,'"') end,'}')
               else concat('free text ',cause) end as raw_text""",
        )
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets are the event ids: rising per partition, with holes as on a compacted topic."""
    return table(spark, sf_dir, "events").selectExpr(
        "'app.logs' as topic",
        "user_id%8 as part",
        "event_id as off",
        f"concat('u',user_id,'-',{US} div 3600000000) as trace_id",
        f"not (({US} div 3600000000)>=474000 and ({US} div 3600000000)%7=0) as done",
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id as key", "event_id as seq", f"{US} as us")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flush attempts of a bundle (one per user): errors and clicks fail."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as bundle", "event_id as seq", f"{US} as us", "event_type not in ('error','click') as ok", "props as record"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with the request (one per day) they came in."""
    return logs(spark, sf_dir).withColumn("request_id", F.expr("substring(timestamp, 1, 10)"))


def stored_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses over several years: one per order, a trace per customer."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "concat('c', o_custkey) as trace_id",
        "o_orderstatus as analysis",
        "'m' as model",
        "concat('v', o_orderkey % 3 + 1) as prompt_version",
        "cast(o_orderdate as timestamp) as created_at",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of repeated runs: the assistant turns of a conversation, numbered by rank among them.

    Turns are consecutive and roles alternate, so the rank is half the distance to the first assistant turn.
    """
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    first = said.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    vectors = vector_table(spark, sf_dir)
    n_vectors = vectors.count()  # ids are 0 to n-1; runs are spread over all of them
    rows = said.join(first, "conv_id").selectExpr(
        "conv_id as case_id",
        "(turn - first_turn) div 2 as run_idx",
        "concat('v',conv_id%2+2) as version",
        "case when turn=3 then '' else text end as text",
        "case when turn=3 then 'timeout' end as err",
        f"pmod((conv_id*8+turn)*7919, {n_vectors}) as vec_id",
        "(length(text)%40)/10.0D as latency_s",
    )
    return rows.join(vectors, "vec_id", "left").selectExpr(
        "case_id", "run_idx", "version", "text", "err", "latency_s", "vec_id", "vector",
        "case when case_id%9=0 then null else concat('c', label) end as category",
    )


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as vector", "label")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answer per case: the first user turn, its words as keywords, its vector."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    first = said.groupBy("conv_id").agg(F.min_by("text", "turn").alias("gold"))
    vectors = vector_table(spark, sf_dir)
    n_vectors = vectors.count()
    # every third word is expected, every fifth is not
    rows = first.selectExpr(
        "conv_id as case_id",
        "gold",
        "filter(split(gold, ' '), (w, i) -> i % 3 = 0) as expected_keywords",
        "case when conv_id%10=0 then cast(array() as array<string>) else filter(split(gold, ' '), (w, i) -> i % 5 = 1) end as anti_keywords",
        f"pmod(conv_id*8*7919, {n_vectors}) as gold_vec_id",
    )
    vectors = vectors.selectExpr("vec_id as gold_vec_id", "vector as gold_vector")
    return rows.join(vectors, "gold_vec_id", "left").drop("gold_vec_id")
