"""Scoring of answers, agreement between runs, the evaluation report and the comparison of two versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlewise.functions.rounding import round_exact
from bundlewise.functions.scoring import DELTA_THRESHOLD, PASS_SCORE, blended_score, cosine, keyword_scores, unit


def primary_run(runs: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Per case the first run's answer, with the columns `also`, and the error that counts.

    Runs: `case_id, run_idx, version, text, category, err, latency_s`. The error is the earliest of any run, and only where the
    first run has no text.
    """
    first = F.min_by(F.struct("version", "text", "category", "latency_s", *also), F.col("run_idx"))
    error = F.min_by(F.col("err"), F.when(F.col("err").isNotNull(), F.col("run_idx")))
    agg = runs.groupBy("case_id").agg(first.alias("first"), error.alias("first_err"), F.count("*").alias("n_runs"))
    return agg.select(
        "case_id",
        "n_runs",
        "first.*",
        F.when(F.coalesce(F.col("first.text"), F.lit("")) == "", F.col("first_err")).alias("error"),
    )


def score_keywords(answers: DataFrame, text: str = "text") -> DataFrame:
    """Adds the keyword scores to rows with `expected_keywords` and `anti_keywords`."""
    return answers.select("*", keyword_scores(F.col(text), F.col("expected_keywords"), F.col("anti_keywords")).alias("_k")).select(
        *answers.columns, "_k.*"
    )


def embedding_score(text: Column, gold: Column, text_vector: Column, gold_vector: Column) -> Column:
    """Similarity of answer and gold text; 0.0 where either is empty."""
    empty = (F.coalesce(text, F.lit("")) == "") | (F.coalesce(gold, F.lit("")) == "")
    return F.when(empty, 0.0).otherwise(cosine(text_vector, gold_vector))


def attach_vectors(rows: DataFrame, cache: DataFrame, text: str, name: str) -> DataFrame:
    """Left join of the vectors of a text column from a cache of one model; a text without vector gets NULL."""
    vectors = cache.select(F.col("text").alias(text), F.col("vector").alias(name))
    return rows.join(vectors, text, "left")


def case_scores(cases: DataFrame, mode: str = "both") -> DataFrame:
    """Scored cases from rows with the answer, its error, the gold text, both vectors and the keyword lists.

    No embedding score is given to a case that failed, nor in keyword mode, nor where a column `embedding_error` says that
    a text could not be embedded: `both` then counts the keywords alone.
    """
    scored = score_keywords(cases.withColumn("text", F.coalesce("text", F.lit(""))))
    if mode == "keyword":
        emb = F.lit(None).cast("double")
    else:
        value = round_exact(embedding_score(F.col("text"), F.col("gold"), F.col("text_vector"), F.col("gold_vector")), 3)
        whole = F.col("embedding_error").isNull() if "embedding_error" in cases.columns else F.lit(True)
        emb = F.when(F.col("error").isNull() & whole, value)
    scored = scored.withColumn("embedding_score", emb)
    scored = scored.withColumn("case_score", blended_score(mode, F.col("keyword_score"), F.col("embedding_score")))
    return scored.withColumn("passed", F.col("case_score") >= PASS_SCORE)


def run_agreement(runs: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Mean pairwise cosine and share of equal categories over all pairs of runs of a case.

    Runs: `case_id, run_idx, text, category, vector`; add `version` to `by` where a table holds several versions of a
    case. Pairs with an empty text, or with a missing category, do not enter the respective mean; without any pair it
    is NULL. Each row is a run, whatever its `run_idx`.

    No pair is ever formed. With unit vectors u the sum over pairs is (|sum u|^2 - sum |u|^2) / 2, and equal
    categories are counted by n(n-1)/2 per category, so the work is linear. The runs are read once and shrink to one row
    per case, vector length and category in each task, whose vectors are added up there; a case with very many runs is
    summed by many tasks. Vectors of different length count as cosine 0: they fall in different sums.
    """
    spoken = F.coalesce(F.col("text"), F.lit("")) != ""
    counted = F.coalesce(spoken & (F.size("vector") > 0), F.lit(False))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    each = runs.select(
        F.struct(*by).alias("_case"),
        F.when(counted, F.size("vector")).alias("dim"),
        "category",
        spoken.cast("int").alias("spoken"),
        # the runs that have no vector to count share a sum that is not read
        F.when(counted, unit(F.col("vector"))).otherwise(F.array(F.lit(0.0))).alias("u"),
    )
    added = each.groupBy("_case", "dim", "category").agg(
        F.count("*").alias("n"), F.sum("spoken").alias("spoken"), Summarizer.sum(array_to_vector(F.col("u"))).alias("v"), F.sum(square(F.col("u"))).alias("own")
    )
    sums = added.where("dim is not null").groupBy("_case", "dim").agg(Summarizer.sum(F.col("v")).alias("v"), F.sum("own").alias("own"))
    cos = sums.groupBy("_case").agg((F.sum(square(vector_to_array(F.col("v"))) - F.col("own")) / 2).alias("cos_sum"))

    totals = added.groupBy("_case").agg(F.sum("n").alias("n_runs"), F.sum("spoken").alias("m"))
    kinds = added.where("category is not null").groupBy("_case", "category").agg(F.sum("n").alias("k"))
    kinds = kinds.groupBy("_case").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("same"), F.sum("k").alias("named"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    joined = totals.join(cos, "_case", "left").join(kinds, "_case", "left")
    return joined.select(
        "_case.*",
        "n_runs",
        F.when(F.col("m") > 1, round_exact(F.coalesce("cos_sum", F.lit(0.0)) / pairs("m"), 3)).alias("pairwise_cos"),
        F.when(F.col("named") > 1, round_exact(F.col("same") / pairs("named"), 3)).alias("category_agreement"),
    )


def eval_report(results: DataFrame, by: str = "version") -> DataFrame:
    """One row per version over scored cases with `error`, scores, agreement and latency.

    Means run over succeeded cases; score, keyword and latency means are 0.0 when there is none, the
    others NULL.
    """
    ok = F.col("error").isNull()

    def mean(name: str, default: float | None = 0.0) -> Column:
        # the inputs have three decimals: their decimal sum is exact in whatever order tasks deliver them
        value = F.when(ok, F.col(name).cast("decimal(18,3)"))
        m = round_exact(F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0)), 3)
        return (m if default is None else F.coalesce(m, F.lit(default))).alias(f"mean_{name}")

    return results.groupBy(by).agg(
        F.count("*").alias("n_cases"),
        F.count_if(ok).alias("n_succeeded"),
        F.count_if(ok & (F.col("case_score") >= PASS_SCORE)).alias("n_passing"),
        mean("case_score").alias("mean_score"),
        mean("keyword_score"),
        mean("embedding_score", None),
        mean("pairwise_cos", None).alias("mean_agreement_pairwise_cos"),
        mean("category_agreement", None).alias("mean_agreement_category"),
        mean("latency_s"),
    )


def compare_versions(a: DataFrame, b: DataFrame, threshold: float = DELTA_THRESHOLD) -> DataFrame:
    """Per case id of either side: both scores, their difference and a marker.

    `↑` / `↓` for a change beyond the threshold, a blank for less, `?` where one side has no score.
    """
    left = a.select("id", F.col("case_score").alias("a"))
    right = b.select("id", F.col("case_score").alias("b"))
    delta = F.col("b") - F.col("a")
    marker = (
        F.when(F.col("delta").isNull(), "?").when(F.col("delta") > threshold, "↑").when(F.col("delta") < -threshold, "↓").otherwise(" ")
    )
    return left.join(right, "id", "full").withColumn("delta", delta).withColumn("marker", marker)
