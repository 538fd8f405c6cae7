"""Evaluation of a prompt version over a set of labelled cases, as one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlewise.functions.responses import enrich
from bundlewise.operators import evaluation as E
from bundlewise.operators.correlate import bundle_text, correlatable
from bundlewise.operators.hooks import Analyzer, analyze_bundles, embed_results, missing_texts
from bundlewise.operators.prompts import render_prompts
from bundlewise.session import cut_lineage

Embedder = Callable[[], Callable[[list[str]], list[list[float]]]]


def case_logs(cases: DataFrame) -> DataFrame:
    """The logs of all cases as rows, `case_id` being their scope and the position their `seq`."""
    rows = cases.select(F.col("id").alias("case_id"), F.posexplode("logs").alias("seq", "e"))
    return rows.select("case_id", F.col("seq").cast("bigint").alias("seq"), "e.*")


def first_bundles(cases: DataFrame, window_seconds: int) -> DataFrame:
    """The bundle a case is judged by: that of the trace with the earliest log, ties by input order."""
    logs = case_logs(cases)
    leads = correlatable(logs).groupBy("case_id").agg(F.min_by("trace_id", F.struct("us", "seq")).alias("trace_id"))
    parts = bundle_text(logs, window_seconds, scope=["case_id"]).join(leads, ["case_id", "trace_id"])
    # a case is one row of input, so its bundle fits into one row again
    texts = F.array_sort(F.collect_list(F.struct("part", "log_text"))).getField("log_text")
    return parts.groupBy("case_id", "trace_id").agg(F.array_join(texts, "\n").alias("log_text"))


def run_eval(
    cases: DataFrame,
    prompts: DataFrame,
    make_analyzer: Callable[[], Analyzer],
    version: str,
    scorer: str = "both",
    runs: int = 1,
    window_seconds: int = 60,
    temperature: float = 0.2,
    cache: DataFrame | None = None,
    make_embedder: Embedder | None = None,
    model: str = "embedder",
    pause: float = 1.0,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(scored cases, report, new rows for the embedding cache).

    Every case is answered `runs` times with seeds 1..runs; the first run is scored, all runs enter the
    agreement. Each distinct text is embedded once, and only if the cache lacks it. Answers are checkpointed:
    the analyzer is called once per case and run.
    """
    if prompts.where(F.col("version") == version).isEmpty():
        raise ValueError(f"unknown prompt version: {version}")
    bundles = first_bundles(cases, window_seconds)
    asked, _ = render_prompts(bundles, prompts, window_seconds, version)
    asked = asked.select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("seed"), F.lit(temperature).alias("temperature"))
    answered = cut_lineage(analyze_bundles(asked, make_analyzer, pause=pause))
    answers = answered.select(
        "case_id",
        "trace_id",
        (F.col("seed") - 1).cast("bigint").alias("run_idx"),
        F.col("prompt_version").alias("version"),
        F.coalesce("raw_text", F.lit("")).alias("text"),
        enrich(F.col("raw_text"), F.col("prompt_version"))["category"].alias("category"),
        F.col("error").alias("err"),
        "latency_s",
    )
    gold = cases.select(F.col("id").alias("case_id"), F.coalesce("gold", F.lit("")).alias("gold"), "expected_keywords", "anti_keywords")
    new = None
    needs_vectors = scorer != "keyword" or runs > 1
    if needs_vectors:
        if make_embedder is None:
            raise ValueError("this scorer needs an embedder")
        texts = answers.select("text").unionByName(gold.select(F.col("gold").alias("text")))
        if cache is None:
            cache = cases.sparkSession.createDataFrame([], "model string, text string, vector array<double>")
        made = cut_lineage(embed_results(missing_texts(texts, cache, model), make_embedder))
        new = made.where("error is null").drop("error")
        known = cache.where(F.col("model") == model).select("model", "text", "vector").unionByName(new)
        lost = made.where("error is not null").select("text", F.col("error").alias("embedding_error"))
        answers = E.attach_vectors(answers, known, "text", "vector")
        gold = E.attach_vectors(gold, known, "gold", "gold_vector")
    else:
        answers = answers.withColumn("vector", F.lit(None).cast("array<double>"))
        gold = gold.withColumn("gold_vector", F.lit(None).cast("array<double>"))

    first = E.primary_run(answers, also=["trace_id", "vector"]).withColumnRenamed("vector", "text_vector")
    judged = first.join(gold, "case_id")
    if needs_vectors:
        # a text that could not be embedded costs its cases the embedding score, not the job
        judged = judged.join(lost, "text", "left").withColumnRenamed("embedding_error", "_own")
        judged = judged.join(lost.withColumnRenamed("text", "gold"), "gold", "left")
        judged = judged.withColumn("embedding_error", F.coalesce("_own", "embedding_error")).drop("_own")
    scored = E.case_scores(judged, scorer)
    scored = scored.drop("text_vector", "gold_vector")
    if runs > 1:
        scored = scored.join(E.run_agreement(answers).drop("n_runs"), "case_id", "left")
    else:
        none = F.lit(None).cast("double")
        scored = scored.withColumn("pairwise_cos", none).withColumn("category_agreement", none)
    report = E.eval_report(scored).select("*", F.lit(scorer).alias("scorer"), F.lit(runs).alias("runs"), F.lit(temperature).alias("temperature"))
    return scored, report, new
