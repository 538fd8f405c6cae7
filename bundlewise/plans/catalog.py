"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise import schemas
from bundlewise.functions.responses import (
    CATEGORIES,
    CONFIDENCES,
    enrich,
    evidence_json,
    in_vocabulary,
    json_fields,
    key_value_fields,
)
from bundlewise.functions.rounding import round_exact
from bundlewise.functions.scoring import cosine
from bundlewise.functions.timestamps import iso_utc, micros, parse_ts, utc_day
from bundlewise.operators import correlate as C
from bundlewise.operators import evaluation as E
from bundlewise.operators import governance as G
from bundlewise.operators import metrics as M
from bundlewise.operators.bundles import assign_bundles, bundle_heads
from bundlewise.operators.hooks import embed_results, embed_texts, missing_texts
from bundlewise.operators.prompts import render_prompts
from bundlewise.plans import fixtures as X
from bundlewise.plans.triage import analyzed_bundles, default_prompts, run_batch, run_job, stub_analyzer
from bundlewise.session import store
from bundlewise.sources import logs as L
from bundlewise.sources import stores as S
from bundlewise.sources.commits import CommittedTables
from bundlewise.streaming.aggregates import counter_stream, session_stream, spend_stream
from bundlewise.streaming.ingest import accepted, decoded_stream
from bundlewise.streaming.micro import EVENT, PROCESSING, StreamBundler, TriageStream, run_available
from bundlewise.streaming.run import DRAIN_KEY, run_and_drain, run_folder, run_to_end

Query = Callable[[SparkSession, str], DataFrame]

DAY_US = 86_400_000_000
IDLE_SECONDS = 600
BATCH_MAX = 2
RETENTION_MONTH = "1998-01"


def _e8(col: str) -> Column:
    """Money as an exact integer of 1e-8 dollars."""
    return (F.col(col) * 100_000_000).cast("bigint")


# ---- ingest -------------------------------------------------------------------------------------------------


def parse_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    fmt = lambda f: f"date_format(ts, \"{f}\")"
    text = f"""case event_id % 14
        when 0 then {X.ISO}
        when 1 then {fmt("yyyy-MM-dd HH:mm:ss.SSSSSS")}
        when 2 then concat({fmt("yyyy-MM-dd'T'HH:mm:ss")}, '+05:30')
        when 3 then {fmt("yyyy-MM-dd")}
        when 4 then {fmt("yyyyMMdd'T'HHmmss'Z'")}
        when 5 then {fmt("yyyy-MM-dd'T'HH:mm:ss','SSS")}
        when 6 then {fmt("yyyy")}
        when 7 then {fmt("HH:mm:ss")}
        when 8 then concat('  ', {fmt("yyyy-MM-dd'T'HH:mm")}, 'Z ')
        when 9 then concat({fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")}, '789-02:00')
        when 10 then {fmt("yyyy-MM-dd'T'HH")}
        when 11 then concat({fmt("yyyyMMdd HHmm")}, '+0530')
        when 12 then concat({fmt("yyyy-MM-dd'T'HH:mm:ss")}, ' Europe/Paris')
        else {fmt("yyyy-MM")} end"""
    rows = X.table(spark, sf, "events").selectExpr("event_id as seq", f"{text} as timestamp")
    return rows.select("seq", micros(parse_ts(F.col("timestamp"))).alias("us"))


def validate_logs(spark: SparkSession, sf: str) -> DataFrame:
    messages = X.messages_of(X.table(spark, sf, "events"))
    return L.validate(L.decode(messages)).select(
        F.col("offset").alias("seq"), F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    )


def raw_logs_normalized(spark: SparkSession, sf: str) -> DataFrame:
    messages = X.messages_of(X.table(spark, sf, "events"))
    rows = L.raw_log_rows(L.decode(messages).withColumn("seq", F.col("offset")))
    return rows.select("seq", "trace_id", "level", "message", micros(F.col("ts")).alias("us"), "payload", "day")


def ingest_by_source(spark: SparkSession, sf: str) -> DataFrame:
    logs = X.logs(spark, sf)
    parts = {name: logs.where(F.col("source") == name).drop("source") for name in ("kafka", "http")}
    return L.union_sources(parts).groupBy("source").agg(F.count("*").alias("n"))


def client_key(spark: SparkSession, sf: str) -> DataFrame:
    forwarded = "case event_id%4 when 0 then concat(' 10.0.0.', user_id, ' , 10.1.1.1') when 1 then '' end"
    host = "case when event_id%4 < 3 then concat('h', user_id) end"
    rows = X.table(spark, sf, "events").selectExpr("event_id as seq", f"{forwarded} as fwd", f"{host} as host")
    return rows.select("seq", L.client_key(F.col("fwd"), F.col("host")).alias("client"))


def _typical_request(requests: DataFrame) -> int:
    """The mean size of a request, rounded down: at any scale some are larger and some are not."""
    n = requests.where("request_id is not null").agg(F.count_distinct("request_id").alias("requests")).first()["requests"]
    return requests.count() // max(n, 1)


def oversize_requests(spark: SparkSession, sf: str) -> DataFrame:
    requests = X.requests(spark, sf)
    return L.request_sizes(requests, "request_id", limit=_typical_request(requests))


def accepted_requests(spark: SparkSession, sf: str) -> DataFrame:
    requests = X.requests(spark, sf)
    kept = L.within_request_limit(requests, "request_id", limit=_typical_request(requests))
    return kept.groupBy("request_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


# ---- correlation --------------------------------------------------------------------------------------------


def trace_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return C.trace_bounds(C.correlatable(X.logs(spark, sf)))


def correlate_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return C.correlate(X.logs(spark, sf), fields=[]).drop("us")


def correlate_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return C.correlate_sizes(X.logs(spark, sf))


def correlate_by_request(spark: SparkSession, sf: str) -> DataFrame:
    return C.correlate_sizes(X.requests(spark, sf), window_seconds=3600, scope=["request_id"])


def bundle_text(spark: SparkSession, sf: str) -> DataFrame:
    return C.bundle_text(X.logs(spark, sf)).drop("n_parts", "part")


def assign_bundles_query(spark: SparkSession, sf: str) -> DataFrame:
    valid = C.correlatable(X.logs(spark, sf)).where("trace_id <> ''")
    assigned = assign_bundles(valid, IDLE_SECONDS * 1_000_000, BATCH_MAX)
    return bundle_heads(assigned, BATCH_MAX)


# ---- answers ------------------------------------------------------------------------------------------------


def render_prompts_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.table(spark, sf, "documents").select("doc_id", F.col("text").alias("log_text"))
    version = F.concat(F.lit("v"), F.col("doc_id") % 4 + 1)
    rendered, rejected = render_prompts(docs, default_prompts(spark), 60, version)
    return rendered.select("doc_id", "version", F.md5("user_message").alias("message_hash"), F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejected.select("doc_id", "version", F.lit(None).cast("string").alias("message_hash"), "reject_reason")
    )


def _flat(fields: Column) -> list[Column]:
    return [
        fields["category"].alias("category"),
        fields["root_cause"].alias("root_cause"),
        fields["next_step"].alias("next_step"),
        F.array_join(fields["evidence"], "|").alias("evidence"),
        fields["confidence"].alias("confidence"),
    ]


def parse_kv_response(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.answers(spark, sf).select("doc_id", key_value_fields(F.col("raw_text")).alias("f"))
    return rows.select("doc_id", *_flat(F.col("f")))


def parse_json_response(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.answers(spark, sf).select("doc_id", json_fields(F.col("raw_text")).alias("f"))
    return rows.select("doc_id", *_flat(F.col("f")))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return X.answers(spark, sf).select("doc_id", "version", enrich(F.col("raw_text"), F.col("version")).alias("f")).select(
        "doc_id", "version", "f.*"
    )


def enrich_responses(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).withColumn("evidence", evidence_json(F.col("evidence")))


def vocab_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _enriched(spark, sf).where("category is not null or confidence is not null")
    return rows.groupBy("version").agg(
        F.count("*").alias("n"),
        F.count_if(~in_vocabulary(F.col("category"), CATEGORIES)).alias("bad_category"),
        F.count_if(~in_vocabulary(F.col("confidence"), CONFIDENCES)).alias("bad_confidence"),
    )


def analyze_stub(spark: SparkSession, sf: str) -> DataFrame:
    done = analyzed_bundles(X.logs(spark, sf), default_prompts(spark), stub_analyzer)
    return done.select("trace_id", "n_logs", "raw_text", "model", "completion_tokens", "error")


# ---- the whole batch and its tables -------------------------------------------------------------------------


def triage_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: the whole batch job, read back from the analyses it has stored."""
    logs = X.logs(spark, sf)
    folder = run_folder(spark, "triage")
    run_batch(logs, default_prompts(spark), stub_analyzer, f"{folder}/raw_logs", f"{folder}/analyses")
    stored = S.read_analyses(spark, f"{folder}/analyses")
    return stored.select("trace_id", "log_text", "model", "prompt_version", "category", "root_cause", "evidence", "confidence")


def analyses_by_month(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.stored_analyses(spark, sf)
    folder = run_folder(spark, "analyses")
    S.write_analyses(rows, folder)
    return S.read_analyses(spark, folder).groupBy("created_month").agg(
        F.count("*").alias("n"), F.countDistinct("trace_id").alias("n_traces")
    )


def latest_analysis(spark: SparkSession, sf: str) -> DataFrame:
    newest = S.latest_analysis(X.stored_analyses(spark, sf))
    return newest.select("trace_id", "id", "analysis", "prompt_version", iso_utc(F.col("created_at")).alias("created_at"))


def retention_keep(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_folder(spark, "retention")
    S.write_analyses(X.stored_analyses(spark, sf), folder)
    kept = S.drop_before(S.read_analyses(spark, folder), RETENTION_MONTH)
    return kept.select("id", "trace_id", "created_month")


# ---- governance ---------------------------------------------------------------------------------------------


def call_cost(spark: SparkSession, sf: str) -> DataFrame:
    return G.call_cost(X.calls(spark, sf)).select("call_id", _e8("cost").alias("cost_e8"))


def daily_spend(spark: SparkSession, sf: str) -> DataFrame:
    return G.daily_spend(X.calls(spark, sf)).select("day", _e8("spent").alias("spent_e8"), "n_calls")


def budget_status(spark: SparkSession, sf: str) -> DataFrame:
    return G.budget_status(X.calls(spark, sf), 5.0)


def budget_admission(spark: SparkSession, sf: str) -> DataFrame:
    return G.budget_admission(X.calls(spark, sf), 2.0).select("call_id", "day", "allowed")


def trailing_hits(spark: SparkSession, sf: str) -> DataFrame:
    return G.trailing_hits(X.hits(spark, sf), "key", DAY_US).select("key", "us", "hits")


def rate_limit_admission(spark: SparkSession, sf: str) -> DataFrame:
    out = G.rate_limit_admission(X.hits(spark, sf), "key", 3, DAY_US)
    return out.select("key", "seq", "allowed", F.round(F.col("retry_after_s") * 1e6).cast("bigint").alias("retry_us"), "retry_header")


def rate_limit_busy_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Three keys share all hits and are hardly ever silent for a day; their stretches are walked in cells."""
    hits = X.hits(spark, sf).withColumn("key", F.col("key") % 3)
    out = G.rate_limit_admission(hits, "key", 40, DAY_US, cell_rows=512)
    return out.select("key", "seq", "allowed", F.round(F.col("retry_after_s") * 1e6).cast("bigint").alias("retry_us"), "retry_header")


def failure_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return G.failure_incidents(X.calls(spark, sf), ["service"], F.col("status") == "ok", threshold=3)


def retry_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return G.retry_outcomes(X.attempts(spark, sf), ["bundle"], F.col("ok"), 3).select("bundle", "seq", "attempt", "outcome")


def dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = G.retry_outcomes(X.attempts(spark, sf), ["bundle"], F.col("ok"), 3)
    folder = run_folder(spark, "dlq")
    S.write_dead_letters(G.dead_letters(outcomes), folder)
    return spark.read.schema("bundle bigint, seq bigint, record string, attempt bigint, reason string").parquet(folder)


def safe_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return G.safe_offsets(X.ledger(spark, sf))


def safe_offsets_for_trace(spark: SparkSession, sf: str) -> DataFrame:
    ledger = X.ledger(spark, sf)
    trace = ledger.where("not done").agg(F.min("trace_id")).first()[0] or ""
    return G.safe_offsets_for_trace(ledger, trace)


# ---- metrics ------------------------------------------------------------------------------------------------


def triage_counters(spark: SparkSession, sf: str) -> DataFrame:
    logs, calls = X.logs(spark, sf), X.calls(spark, sf)
    valid = L.raw_log_rows(logs)
    bounds = C.trace_bounds(C.correlatable(logs)).withColumn("day", utc_day(F.timestamp_micros("first_us")))
    outcomes = G.retry_outcomes(X.attempts(spark, sf), ["bundle"], F.col("ok"), 3)
    outcomes = outcomes.withColumn("day", utc_day(F.timestamp_micros("us")))
    # counters of one frame are counted in one pass over it
    by_request = C.trace_bounds(C.correlatable(X.requests(spark, sf)), scope=["request_id"])
    by_request = by_request.withColumn("day", utc_day(F.timestamp_micros("first_us")))
    none = F.lit("")
    return M.counters(
        {
            "logs_ingested": (valid, F.col("source")),
            "windows_correlated": (bounds, none),
            "results": (by_request, F.col("request_id")),
            "calls": (calls.withColumn("day", utc_day(F.col("ts"))), F.col("status")),
            "raw_logs_persisted": (valid, none),
            "bundle_retries": (outcomes, none, F.col("outcome") == "retry"),
            "bundles_dlq": (outcomes, none, F.col("outcome") == "dead_letter"),
        }
    )


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    out = M.latency_histogram(X.calls(spark, sf), ["service"])
    return out.select("service", "le", "n", "count", F.round("sum", 3).alias("sum"))


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = M.latency_summary(X.calls(spark, sf), ["service"])
    return out.select("service", "n", F.round("mean_s", 6).alias("mean_s"), "p95_s", F.round("rate_per_s", 6).alias("rate_per_s"))


# ---- evaluation ---------------------------------------------------------------------------------------------


def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    vectors = X.vector_table(spark, sf)
    nxt = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("next"))
    return vectors.join(nxt, "vec_id", "left").select("vec_id", F.round(cosine(F.col("vector"), F.col("next")), 6).alias("cos"))


def _stub_embedder():
    return lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]


def embed_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of all runs against a cache that holds the gold answers."""
    model = "embedder"
    cache = X.gold(spark, sf).select(F.lit(model).alias("model"), F.col("gold").alias("text"), F.col("gold_vector").alias("vector"))
    new = embed_texts(missing_texts(X.runs(spark, sf), cache, model), _stub_embedder)
    return new.select(F.md5("text").alias("text_hash"), F.col("vector")[0].cast("bigint").alias("n_chars"), F.col("vector")[1].cast("bigint").alias("n_a"))


def embed_missing_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the cache as a bucketed table: the look-up shuffles the texts only."""
    folder, name = run_folder(spark, "cache"), f"cache_{uuid.uuid4().hex}"
    gold = X.gold(spark, sf).select(F.lit("embedder").alias("model"), F.col("gold").alias("text"), F.col("gold_vector").alias("vector"))
    S.append_embedding_table(gold, name, buckets=8, path=folder)
    try:
        new = store(embed_results(missing_texts(X.runs(spark, sf), spark.table(name), "embedder"), _stub_embedder))
    finally:
        spark.sql(f"drop table {name}")
    done = new.where("error is null")
    return done.select(F.md5("text").alias("text_hash"), F.col("vector")[0].cast("bigint").alias("n_chars"), F.col("vector")[1].cast("bigint").alias("n_a"))


def _cases(spark: SparkSession, sf: str, runs: DataFrame | None = None) -> DataFrame:
    """Primary answers with gold texts, keyword lists and vectors."""
    runs = X.runs(spark, sf) if runs is None else runs
    first = E.primary_run(runs, also=["vector"]).withColumnRenamed("vector", "text_vector")
    return first.join(X.gold(spark, sf), "case_id")


def primary_run(spark: SparkSession, sf: str) -> DataFrame:
    out = E.primary_run(X.runs(spark, sf))
    return out.select("case_id", "n_runs", "version", F.md5("text").alias("text_hash"), "category", "latency_s", "error")


def score_keywords(spark: SparkSession, sf: str) -> DataFrame:
    out = E.score_keywords(_cases(spark, sf))
    return out.select(
        "case_id",
        "keyword_hit",
        "anti_clean",
        "keyword_score",
        F.array_join("missed_keywords", "|").alias("missed"),
        F.array_join("anti_violations", "|").alias("violations"),
    )


def score_embedding(spark: SparkSession, sf: str) -> DataFrame:
    value = E.embedding_score(F.col("text"), F.col("gold"), F.col("text_vector"), F.col("gold_vector"))
    return _cases(spark, sf).select("case_id", F.round(value, 6).alias("score"))


def case_scores(spark: SparkSession, sf: str) -> DataFrame:
    cases = _cases(spark, sf)
    out: DataFrame | None = None
    for mode in ("keyword", "embedding", "both"):
        one = E.case_scores(cases, mode).select("case_id", F.lit(mode).alias("mode"), "embedding_score", "case_score", "passed")
        out = one if out is None else out.unionByName(one)
    return out


def run_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return E.run_agreement(X.runs(spark, sf))


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    runs = store(X.runs(spark, sf))  # read by the scores and by the agreement
    scored = E.case_scores(_cases(spark, sf, runs), "both").drop("n_runs")
    agreed = E.run_agreement(runs).drop("n_runs")
    return E.eval_report(scored.join(agreed, "case_id", "left"))


def compare_versions(spark: SparkSession, sf: str) -> DataFrame:
    """First against second run of every case; cases with a single run have no score on the second side."""
    runs, gold = X.runs(spark, sf), X.gold(spark, sf)

    def scored(run: int) -> DataFrame:
        rows = runs.where(F.col("run_idx") == run).withColumn("error", F.col("err")).withColumnRenamed("vector", "text_vector")
        out = E.case_scores(rows.join(gold, "case_id"), "both")
        return out.select(F.concat(F.lit("case"), F.col("case_id")).alias("id"), "case_score")

    out = E.compare_versions(scored(0), scored(1))
    return out.withColumn("delta", round_exact(F.col("delta"), 6)).orderBy("id")


# ---- streams ------------------------------------------------------------------------------------------------


def _stream_logs(spark: SparkSession, sf: str) -> DataFrame:
    messages = X.messages_of(X.table_stream(spark, sf, "events"))
    good = accepted(decoded_stream(messages))
    return good.select("trace_id", "ts", "seq", "timestamp", "level", "message", "topic")


def _last_us(spark: SparkSession, sf: str) -> int:
    return X.table(spark, sf, "events").selectExpr(f"max({X.US})").first()[0] or 0


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    messages = X.messages_of(X.table_stream(spark, sf, "events"))
    out = decoded_stream(messages).select(
        "topic", "partition", "offset", "trace_id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    )
    return run_to_end(out, run_folder(spark, "ingest"))


def _drained(spark: SparkSession, sf: str, stream: DataFrame, build, margin_us: int, key: str) -> DataFrame:
    out = run_and_drain(stream, build, run_folder(spark, "stream"), _last_us(spark, sf), margin_us, key)
    return out.where(F.col(key) != DRAIN_KEY) if key in out.columns else out


STREAM_BUNDLE = ["trace_id", "first_us", "last_us", "first_seq", "last_seq", "n_logs", "reason"]


def _bundled(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    folder = run_folder(spark, "bundles")
    target = StreamBundler(spark, f"{folder}/tables", mode=mode, idle_seconds=IDLE_SECONDS, batch_max=BATCH_MAX, clock=lambda: 0.0)
    run_available(decoded_stream(X.messages_of(X.table_stream(spark, sf, "events"))), target, f"{folder}/checkpoint")
    return target.bundles().select(*STREAM_BUNDLE, F.md5("log_text").alias("text_hash"))


def stream_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return _bundled(spark, sf, EVENT)


def stream_bundles_arrival(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the order of arrival (one micro-batch, so the offset), under a clock that stands still: count, then drain."""
    return _bundled(spark, sf, PROCESSING)


def _fixed_time() -> Column:
    return F.lit("2026-05-06 10:00:00").cast("timestamp")


def stream_triage(spark: SparkSession, sf: str) -> DataFrame:
    """Messages to the batch job's tables in one streaming job; the newest analysis of each trace and its raw log rows."""
    folder = run_folder(spark, "stream-triage")
    target = TriageStream(
        spark, f"{folder}/tables", default_prompts(spark), stub_analyzer,
        created_at=_fixed_time(), idle_seconds=IDLE_SECONDS, batch_max=BATCH_MAX,
    )
    run_available(decoded_stream(X.messages_of(X.table_stream(spark, sf, "events"))), target, f"{folder}/checkpoint")
    stored = target.analyses().groupBy("trace_id").agg(
        F.count("*").alias("n_analyses"), F.sum(F.regexp_extract("root_cause", "^([0-9]+) of", 1).cast("bigint")).alias("n_errors"),
    )
    raw = target.raw_logs().groupBy("trace_id").agg(F.count("*").alias("n_raw"))
    newest = S.latest_analysis(target.analyses()).select("trace_id", "model", "prompt_version", iso_utc(F.col("created_at")).alias("created_at"))
    return stored.join(raw, "trace_id").join(newest, "trace_id")


def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What the streaming job refused, read from its committed table."""
    folder = run_folder(spark, "stream-rejects")
    target = StreamBundler(spark, f"{folder}/tables", idle_seconds=IDLE_SECONDS, batch_max=BATCH_MAX)
    run_available(decoded_stream(X.messages_of(X.table_stream(spark, sf, "events"))), target, f"{folder}/checkpoint", drain=False)
    return target.rejected().groupBy("reject_reason", "partition").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))


def job_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Spend of the batch job's own calls, from the tokens it stored."""
    tables = CommittedTables(spark, run_folder(spark, "job"))
    run_job(X.logs(spark, sf), default_prompts(spark), stub_analyzer, tables, "all", created_at=_fixed_time())
    spend = G.daily_spend(tables.read("calls", schemas.CALL))
    return spend.select("day", _e8("spent").alias("spent_e8"), "n_calls")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    build = lambda logs: session_stream(logs, IDLE_SECONDS, f"{IDLE_SECONDS} seconds")
    return _drained(spark, sf, _stream_logs(spark, sf), build, 4 * IDLE_SECONDS * 1_000_000, "trace_id")


def stream_daily_spend(spark: SparkSession, sf: str) -> DataFrame:
    calls = X.table_stream(spark, sf, "events").selectExpr(*X.CALL_FIELDS)
    calls = calls.select("ts", "model", "prompt_tokens", "completion_tokens")
    # the drain record has no tokens, so its own day has no spend
    out = _drained(spark, sf, calls, spend_stream, 5 * DAY_US, "model")
    return out.where(F.col("spent").isNotNull()).select("day", _e8("spent").alias("spent_e8"), "n_calls")


def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    logs = X.table_stream(spark, sf, "events").selectExpr(*X.LOG_FIELDS, "cast(ts as timestamp) as ts").select("ts", "source")
    return _drained(spark, sf, logs, counter_stream, DAY_US, "source")


def queries() -> dict[str, Query]:
    fns = [
        parse_timestamps, validate_logs, raw_logs_normalized, ingest_by_source, client_key, oversize_requests,
        accepted_requests, trace_bounds, correlate_bundles, correlate_sizes, correlate_by_request, bundle_text,
        parse_kv_response, parse_json_response, enrich_responses, vocab_violations, analyze_stub, triage_bundles,
        analyses_by_month, latest_analysis, retention_keep, call_cost, daily_spend, budget_status,
        budget_admission, trailing_hits, rate_limit_admission, failure_incidents, retry_outcomes, dead_letter,
        safe_offsets, safe_offsets_for_trace, triage_counters, latency_histogram, latency_summary, cosine_pairs,
        embed_missing, primary_run, score_keywords, score_embedding, case_scores, run_agreement, eval_report,
        compare_versions, stream_ingest, stream_bundles, stream_sessions, stream_daily_spend, stream_counters,
        rate_limit_busy_keys, embed_missing_bucketed, stream_bundles_arrival, stream_triage, stream_rejects, job_spend,
    ]
    out: dict[str, Query] = {f.__name__: f for f in fns}
    out["assign_bundles"] = assign_bundles_query
    out["render_prompts"] = render_prompts_query
    return out


__all__ = ["queries"]
