"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted texts against the raw corpus.

DataFrame functions only. Words and word pairs are hashed to a fixed number of buckets; two multinomials are counted, one
over trusted texts and one over the whole corpus; a text's score is the mean log-ratio of its n-grams.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm.common import stored, table, words

BUCKETS = 8192
#: Log-ratios are held in millionths, so that sums are whole numbers and do not depend on their order.
SCALE = 1_000_000
#: A text is kept if it scores at least as high as all but this share of the trusted texts of enough words.
TAIL = 0.001
MIN_WORDS, REPEAT_SHARE, SPAN = 20, 30, 8


def let(value: Column, body) -> Column:
    """`body` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _pairs(hashes: Column, step: int) -> Column:
    """Hash of each place's value with the one `step` places on: of two n-grams a longer one."""
    last = F.size(hashes) - 1 - step
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(hashes[i], hashes[i + step]))
    return F.when(last >= 0, made).otherwise(F.expr("cast(array() as array<bigint>)"))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs more than once; the usual text has none and costs one hash set."""
    spots = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        n = F.size(s)
        found = F.filter(
            F.transform(s, lambda x, k: F.when(
                ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])), x["i"])),
            lambda x: x.isNotNull(),
        )
        return let(F.sort_array(found), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(SPAN), F.coalesce(F.get(p, k + 1) - x, F.lit(SPAN)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(let(spots, twice))


def grams(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`row`, the text, hashes of its words and of its word pairs."""
    row = F.struct(*[docs[c] for c in keep]) if keep else F.lit(1)
    hashed = docs.select(row.alias("row"), F.coalesce(docs[text], F.lit("")).alias("t")).withColumn("h1", F.transform(words(F.col("t")), lambda w: F.xxhash64(w)))
    return hashed.withColumn("h2", _pairs(F.col("h1"), 1))


def buckets(n: int) -> Column:
    return F.transform(F.concat("h1", "h2"), lambda h: F.pmod(h, F.lit(n)).cast("int"))


def count_buckets(given: DataFrame, n: int) -> dict[int, int]:
    """n-grams by bucket: summed on each task first, so a task sends a row per bucket, and the driver gets `n` rows."""
    return {r["b"]: r["c"] for r in given.select(F.explode(buckets(n)).alias("b")).groupBy("b").agg(F.count("*").alias("c")).collect()}


def log_ratios(target: dict[int, int], raw: dict[int, int], n: int) -> list[int]:
    """Smoothed log-ratio of each bucket, in millionths."""
    a, b = sum(target.values()) + n, sum(raw.values()) + n
    return [round(SCALE * (math.log((target.get(k, 0) + 1) / a) - math.log((raw.get(k, 0) + 1) / b))) for k in range(n)]


def ratio_score(weights: list[int]) -> Column:
    """Mean log-ratio of a text's n-grams in millionths, rounded down; null without n-grams."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<bigint>")
    total = F.aggregate(buckets(len(weights)), F.lit(0).cast("bigint"), lambda a, b: a + F.get(table, b))
    size = F.size("h1") + F.size("h2")
    return F.when(size > 0, F.floor(total / F.greatest(size, F.lit(1)))).cast("bigint")


def trusted_rows(docs: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """All rows of `docs` with a trusted id, by a shuffle: the ids grow with the corpus."""
    ids = labels.where((labels[label] == 1) & labels[doc_id].isNotNull()).select(labels[doc_id].alias("_id")).distinct()
    return docs.join(ids.hint("merge"), docs[doc_id] == ids["_id"], "left_semi")


def low_quantile(scores: DataFrame, one_in: int) -> int | None:
    """The least score `s` that at least one in `one_in` of the rows do not exceed; null without rows.

    Exact, and no task sorts or holds the scores: counts by bins find the bin of that rank, counts by value within the
    bin find the value. Both are summed on each task first; scores are means of log-ratios, so bins are few.
    """
    width = 4096
    bins = sorted((r["b"], r["c"]) for r in scores.groupBy(F.floor(F.col("s") / width).alias("b")).agg(F.count("*").alias("c")).collect())
    rank = -(-sum(c for _, c in bins) // one_in)
    for b, c in bins:
        if rank <= c:
            inside = scores.where(F.floor(F.col("s") / width) == b).groupBy("s").agg(F.count("*").alias("c"))
            for s, times in sorted((r["s"], r["c"]) for r in inside.collect()):
                rank -= times
                if rank <= 0:
                    return int(s)
        rank -= c
    return None


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", n: int = BUCKETS) -> tuple[list[int], int]:
    """(log-ratio of each bucket, threshold). Without trusted texts all ratios are 0 and the threshold keeps every text.

    The target multinomial counts every trusted text, the raw one every text of `docs`. The threshold is a low quantile
    of the scores of all trusted texts of enough words.
    """
    trusted = grams(stored(trusted_rows(docs, labels, doc_id, label).select(docs[text].alias("t"))), "t", [])
    target = count_buckets(trusted, n)
    if not target:
        return [0] * n, -(10**12)
    weights = log_ratios(target, count_buckets(grams(docs, text, []), n), n)
    # narrow, and held before the filter, which would else be pushed below the arrays, where each look-up computes its array anew
    scored = trusted.select(F.when(F.size("h1") >= MIN_WORDS, ratio_score(weights)).alias("s")).persist()
    at = low_quantile(scored.where("s is not null"), round(1 / TAIL))
    scored.unpersist()
    return weights, -(10**12) if at is None else at


def judge(docs: DataFrame, weights: list[int], threshold: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Base counts and verdict of every text; result: `row`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score (millionths), kept. One narrow pass, no shuffle.

    Null and empty texts have no words, fail the base rule and are not kept. Equal rows get equal verdicts. Very long
    texts are arrays of their words within one row. An empty table gives an empty result.
    """
    given = grams(docs, text, docs.columns if keep is None else keep).withColumn("h4", _pairs(F.col("h2"), 2))
    t = F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = given.select(
        "row", "h1", "h2",
        F.size("h1").cast("bigint").alias("n_words"),
        F.char_length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(_pairs(F.col("h4"), 4), _covered).alias("n_repeat_words"),
        ratio_score(weights).alias("score"), F.monotonically_increasing_id().alias("_once"),
    ).drop("h1", "h2")
    # the verdict hangs on a value that is not a function of the row: a filter on it cannot be pushed below the arrays,
    # where each look-up would compute its array anew
    once = F.col("_once") >= 0
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed & once)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)) & once).drop("_once")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights, threshold = fit(docs, labels)
    return judge(docs, weights, threshold, keep=["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
