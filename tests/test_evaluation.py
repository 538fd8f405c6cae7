import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bundlewise.functions.scoring import cosine, keyword_scores
from bundlewise.operators import evaluation as E

RUN = "case_id string, run_idx bigint, version string, text string, category string, err string, latency_s double, vector array<double>"


def test_cosine_is_symmetric_blind_to_scale_and_bounded(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(40, 6)), rng.normal(size=(40, 6))
    scale = rng.uniform(0.01, 90, size=40)
    rows = [(x.tolist(), y.tolist(), (x * k).tolist(), (-x).tolist()) for x, y, k in zip(a, b, scale)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, k array<double>, m array<double>")
    got = df.select(*[cosine(F.col(x), F.col(y)).alias(x + y) for x, y in ("ab", "ba", "kb", "aa", "am")]).collect()
    want = (a * b).sum(axis=1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    for r, w in zip(got, want):
        assert r.ab == pytest.approx(w) == r.ba == pytest.approx(r.kb)
        assert r.aa == pytest.approx(1.0) and r.am == pytest.approx(-1.0) and abs(r.ab) <= 1 + 1e-12


def test_cosine_without_a_direction_is_zero(spark):
    given = [[], [0.0] * 3, [1.0, 2.0, 3.0], [1.0], None]
    pairs = [(x, y) for x in given for y in given if not (x == y and x and any(x))]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    assert {r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()} == {0.0}


def test_keyword_scores(spark):
    df = spark.createDataFrame(
        [("The Pool is exhausted", ["pool", "db"], ["cpu", "EXHAUSTED"]), ("x", [], []), ("all good", ["good"], [])],
        "t string, e array<string>, a array<string>",
    )
    rows = df.select(keyword_scores(F.col("t"), F.col("e"), F.col("a")).alias("k")).select("k.*").collect()
    assert (rows[0].keyword_hit, rows[0].anti_clean, rows[0].keyword_score) == (0.5, 0.5, 0.5)
    assert rows[0].missed_keywords == ["db"] and rows[0].anti_violations == ["EXHAUSTED"]
    assert rows[1].keyword_score == 0.0
    assert rows[2].keyword_score == 0.7  # no anti keywords: that part is lost


def _pairwise(rows):
    """(mean cosine, share of equal categories) over all pairs, by a matrix of dot products per vector length."""
    spoken = [r for r in rows if r[3]]
    n, total = len(spoken), 0.0
    for size in {len(r[7] or ()) for r in spoken} - {0}:
        m = np.array([r[7] for r in spoken if len(r[7] or ()) == size])
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        u = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        total += np.triu(u @ u.T, 1).sum()
    named = np.array([r[4] for r in rows if r[4] is not None], dtype=object)
    same = np.triu(named[:, None] == named[None, :], 1).sum() if len(named) else 0
    pairs = lambda k: k * (k - 1) / 2
    return total / pairs(n) if n > 1 else None, same / pairs(len(named)) if len(named) > 1 else None


@pytest.mark.parametrize("indexes", ["unique", "repeated", "missing"])
def test_agreement_equals_the_mean_over_pairs(spark, indexes):
    """Vectors of two lengths and of none, empty texts, missing categories, many runs under one index."""
    rng = random.Random(indexes)
    rows = []
    for case, n in (("big", 230), ("small", 5), ("two", 2), ("one", 1), (None, 90)):
        for i in range(n):
            text = "" if rng.random() < 0.1 else f"t{i}"
            vector = rng.choice([[rng.gauss(1, 1) for _ in range(rng.choice([3, 4]))], [rng.gauss(0, 1)] * 3, [0.0, 0.0, 0.0], None])
            index = {"unique": i, "repeated": i // 80, "missing": None}[indexes]
            rows.append((case, index, "v", text, rng.choice(["a", "b", None]), None, 0.0, vector))
    got = {r.case_id: r for r in E.run_agreement(spark.createDataFrame(rows, RUN)).collect()}
    assert set(got) == {"big", "small", "two", "one", None}
    for case, row in got.items():
        cos, cat = _pairwise([r for r in rows if r[0] == case])
        assert row.pairwise_cos == (None if cos is None else pytest.approx(cos, abs=6e-4))
        assert row.category_agreement == (None if cat is None else pytest.approx(cat, abs=6e-4))


def test_agreement_of_equal_runs_is_full_however_many(spark):
    rows = [("c", i % 35, f"v{i % 2}", "same", "x", None, 0.0, [0.3, 0.4]) for i in range(140)]
    runs = spark.createDataFrame(rows, RUN)
    assert E.run_agreement(runs).first()["pairwise_cos"] == 1.0
    by_version = E.run_agreement(runs, by=("case_id", "version")).collect()
    assert sorted((r.version, r.n_runs, r.pairwise_cos, r.category_agreement) for r in by_version) == [("v0", 70, 1.0, 1.0), ("v1", 70, 1.0, 1.0)]


def test_primary_run_and_the_error_that_counts(spark):
    rows = [
        ("a", 0, "v", "", None, "late", 1.0, None), ("a", 1, "v", "x", "db", None, 2.0, None),
        ("b", 0, "v", "ok", "db", None, 3.0, None), ("b", 1, "v", "", None, "boom", 4.0, None),
        ("c", 0, "v", "", None, None, 5.0, None), ("c", 1, "v", "", None, "second", 1.0, None), ("c", 2, "v", "", None, "third", 1.0, None),
    ]
    got = {r.case_id: r for r in E.primary_run(spark.createDataFrame(rows, RUN)).collect()}
    assert (got["a"].error, got["a"].latency_s) == ("late", 1.0)
    assert (got["b"].error, got["b"].text, got["b"].category) == (None, "ok", "db")
    assert got["c"].error == "second"


def _cases(spark):
    rows = [
        ("hit", "pool gone", None, ["pool"], ["cpu"], "gold", [1.0, 0.0], [1.0, 0.0], 1.0, "v"),
        ("fail", "", "timeout", ["pool"], ["cpu"], "gold", None, [1.0, 0.0], 9.0, "v"),
        ("nogold", "pool", None, ["pool"], [], "", [1.0, 0.0], None, 3.0, "v"),
    ]
    return spark.createDataFrame(
        rows,
        "case_id string, text string, error string, expected_keywords array<string>, anti_keywords array<string>, gold string, "
        "text_vector array<double>, gold_vector array<double>, latency_s double, version string",
    )


def test_case_scores_by_mode(spark):
    score = lambda mode: {r.case_id: (r.embedding_score, r.case_score, r.passed) for r in E.case_scores(_cases(spark), mode).collect()}
    assert score("keyword") == {"hit": (None, 1.0, True), "fail": (None, 0.3, False), "nogold": (None, 0.7, True)}
    assert score("embedding") == {"hit": (1.0, 1.0, True), "fail": (None, 0.0, False), "nogold": (0.0, 0.0, False)}
    assert score("both") == {"hit": (1.0, 1.0, True), "fail": (None, 0.3, False), "nogold": (0.0, 0.35, False)}
    with pytest.raises(ValueError):
        E.case_scores(_cases(spark), "other")


def test_report_means_run_over_succeeded_cases(spark):
    scored = E.case_scores(_cases(spark), "both").withColumn("pairwise_cos", F.lit(None).cast("double")).withColumn("category_agreement", F.lit(0.5))
    row = E.eval_report(scored).first()
    assert (row.n_cases, row.n_succeeded, row.n_passing) == (3, 2, 1)
    assert (row.mean_score, row.mean_keyword_score, row.mean_embedding_score, row.mean_latency_s) == (0.675, 0.85, 0.5, 2.0)
    assert (row.mean_agreement_pairwise_cos, row.mean_agreement_category) == (None, 0.5)
    empty = E.eval_report(scored.where("error is not null")).first()
    assert (empty.mean_score, empty.mean_keyword_score, empty.mean_embedding_score, empty.mean_latency_s) == (0.0, 0.0, None, 0.0)


def test_comparison_says_which_way_each_case_went(spark):
    rng = random.Random(8)
    score = lambda: {f"c{k}": rng.randrange(0, 1001) / 1000 for k in rng.sample(range(90), 60)}
    a, b = score(), score()
    for k in list(set(a) & set(b))[:12]:  # some small steps, and steps of just the threshold in binary fractions
        b[k] = a[k] + rng.choice([0.0, 0.001, -0.001])
    a["edge"], b["edge"] = 0.25, 0.5
    side = lambda d: spark.createDataFrame(list(d.items()), "id string, case_score double")
    got = {r.id: r for r in E.compare_versions(side(a), side(b), threshold=0.25).collect()}
    assert set(got) == set(a) | set(b)
    for k, r in got.items():
        if k not in a or k not in b:
            assert (r.marker, r.delta) == ("?", None)
        else:
            step = b[k] - a[k]
            assert r.delta == step and r.marker == {(True, False): "↑", (False, True): "↓"}.get((step > 0.25, step < -0.25), " ")
    assert got["edge"].marker == " "
