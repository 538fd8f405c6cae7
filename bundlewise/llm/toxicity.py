"""Toxicity scores: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases.

The lexicon is learned from labels. Terms are whole words and word beginnings (a stem with any ending); their weights are
log-odds of document frequencies. A text's score is a logistic function of the weight found, in all and per word.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm.common import map_arrow, table

#: At most so many labelled texts are learned from, taken in the order of a hash of their id.
MAX_TRAIN = 20_000
#: At most so many terms and exception phrases make up a model, best first.
MAX_TERMS, MAX_PHRASES = 2_000, 500
#: Terms of toxic texts, the most frequent first, whose frequency in clean texts is counted too.
MAX_CANDIDATES = 100_000
#: A term stands in at least this share of the toxic texts learned from, and in this many.
MIN_SHARE, MIN_TEXTS = 0.004, 5
MIN_WEIGHT = 2.5
STEMS = (4, 5, 6, 7, 8)

# fixed values: look-alike letters, and digits and signs written for letters; l and 1 fold with i, they look alike
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "н": "h", "г": "r", "п": "n", "и": "u", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "γ": "y", "σ": "o", "μ": "u", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h",
    "ⅼ": "i", "ℓ": "i", "ø": "o", "đ": "d", "ł": "i", "ħ": "h", "ŧ": "t",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i",
}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t", "£": "i"}
_TABLE = str.maketrans(LOOKALIKES)
_SIGN = re.compile(r"(?<![@$!|€+£])[@$!|€+£](?=[^\W\d_])")  # a single sign before a letter; runs of signs are no spelling
_IGNORED = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])")


def fold(text: str) -> list[str]:
    """Words of a text with case, styled letters, look-alikes and substituted digits folded; plain numbers stay away."""
    if not text.isascii():
        text = _IGNORED.sub("", unicodedata.normalize("NFKC", text))
    text = _NUMBER.sub(" ", text.lower())
    if any(c in text for c in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return _WORD.findall(text.translate(_TABLE))


def terms(folded: list[str]) -> set[str]:
    """Candidate terms: " word " and " stem" (a beginning of words)."""
    own = set(folded)
    return {f" {w} " for w in own} | {f" {w[:k]}" for w in own for k in STEMS if len(w) > k}


@dataclass
class Lexicon:
    weights: dict[str, float]
    phrases: dict[str, str]  # exception phrase -> the term it clears
    intercept: float
    slopes: list[float]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Lexicon:
        return Lexicon(**json.loads(text))


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.found = ahocorasick.Automaton()
        for t, w in lexicon.weights.items():
            self.found.add_word(t, (len(t), w, ""))
        for p, t in lexicon.phrases.items():
            self.found.add_word(p, (len(p), 0.0, t))
        self.empty = not lexicon.weights
        if not self.empty:
            self.found.make_automaton()

    def hits(self, folded: list[str]) -> list[tuple[int, str, float]]:
        """(place, term, weight) of each word's best term, without words that an exception phrase covers."""
        if self.empty or not folded:
            return []
        flat = f" {' '.join(folded)} "
        best: dict[int, tuple[str, float]] = {}
        cleared: list[tuple[int, int, str]] = []
        for end, (size, weight, term) in self.found.iter(flat):
            start = end - size + 1
            if term:
                cleared.append((start, end, term))
            elif start not in best or weight > best[start][1]:
                best[start] = (flat[start : end + 1], weight)
        for a, b, term in cleared:
            for place in [p for p in best if a <= p < b and best[p][0] == term]:
                del best[place]
        return [(p, t, w) for p, (t, w) in sorted(best.items())]

    def features(self, text: str | None) -> tuple[float, float, int]:
        folded = fold(text or "")
        found = self.hits(folded)
        total = sum(w for _, _, w in found)
        return np.log1p(total), np.log1p(200.0 * total / max(len(folded), 20)), len(found)

    def score(self, text: str | None) -> tuple[float, int]:
        a, b, n = self.features(text)
        z = self.lexicon.intercept + self.lexicon.slopes[0] * a + self.lexicon.slopes[1] * b
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), n


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x has a column of ones first."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1)) + np.eye(x.shape[1]) * 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, eligible: Column, max_train: int) -> DataFrame:
    """(text, y): at most `max_train` labelled distinct ids in the order of a hash, so the list may be broadcast."""
    known = (
        labels.where(eligible & labels[doc_id].isNotNull() & labels[label].isin(0, 1))
        .groupBy(labels[doc_id].alias("id")).agg(F.max(labels[label]).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_train)
    )
    given = docs.select(docs[doc_id].alias("id"), docs[text].alias("t"))
    return given.join(F.broadcast(known), "id").where("t is not null").groupBy(F.sha2("t", 256).alias("h")).agg(F.first("t").alias("t"), F.max("y").alias("y"))


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    eligible: Column | None = None, max_train: int = MAX_TRAIN,
) -> Lexicon:
    """Learn a lexicon from labelled texts (equal texts once).

    `eligible` is a condition on `labels`. Terms are counted on Spark, only the selected ones reach the driver (at most
    `MAX_TERMS`). Without toxic labels the lexicon is empty and every score is the same low value. Null ids, labels and
    texts are no examples; a doc_id with several labels is toxic if one says so.
    """
    rows = training_rows(docs, labels, doc_id, text, label, F.lit(True) if eligible is None else eligible, max_train).persist()

    def counter(only: frozenset | None):
        def count(batches):
            import pyarrow as pa

            for batch in batches:
                seen: dict[str, int] = {}
                for t in batch.column("t").to_pylist():
                    found = terms(fold(t))
                    for term in found if only is None else found & only:
                        seen[term] = seen.get(term, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        return count

    sizes = rows.agg(F.expr("count_if(y = 1)").alias("bad"), F.expr("count_if(y = 0)").alias("good")).first()
    bad, good = sizes["bad"] or 0, sizes["good"] or 0
    if not bad or not good:
        rows.unpersist()
        return Lexicon({}, {}, -3.0, [0.0, 0.0])
    need = max(MIN_TEXTS, int(MIN_SHARE * bad))
    of = lambda y, only: rows.where(F.col("y") == y).select("t").mapInArrow(counter(only), "term string, n bigint").groupBy("term")
    toxic = of(1, None).agg(F.sum("n").alias("bad")).where(F.col("bad") >= need).orderBy(F.desc("bad"), "term").limit(MAX_CANDIDATES).persist()
    candidates = frozenset(r["term"] for r in toxic.collect())
    counted = toxic.join(of(0, candidates).agg(F.sum("n").alias("good")), "term", "left").na.fill(0, ["good"])
    weight = F.log((F.col("bad") + 0.5) / (F.lit(bad) - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (F.lit(good) - F.col("good") + 0.5))
    chosen = counted.withColumn("w", weight).where(F.col("w") >= MIN_WEIGHT).orderBy(F.desc("bad"), "term").limit(MAX_TERMS).collect()
    toxic.unpersist()
    # a longer term says nothing new where its beginning is as telling
    weights: dict[str, float] = {}
    for r in sorted(chosen, key=lambda r: (len(r["term"].rstrip()), r["term"])):
        t, w = r["term"], float(r["w"])
        shorter = [weights[t[:k]] for k in range(2, len(t)) if t[:k] in weights]
        if not shorter or w > max(shorter) + 1.0:
            weights[t] = w
    lexicon = Lexicon(weights, {}, 0.0, [1.0, 1.0])
    lexicon.phrases = _exceptions(rows, lexicon)

    def measure(batches):
        import pyarrow as pa

        tool = Matcher(lexicon)
        for batch in batches:
            f = [tool.features(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), batch.column("y")], names=["a", "b", "y"]
            )

    # three numbers a row, at most max_train rows; ordered, so that sums do not depend on the order of tasks
    seen = rows.select("t", "y").mapInArrow(measure, "a double, b double, y int").orderBy("a", "b", "y").toPandas()
    beta = _logistic(np.column_stack([np.ones(len(seen)), seen["a"], seen["b"]]), seen["y"].to_numpy(float))
    rows.unpersist()
    return Lexicon(lexicon.weights, lexicon.phrases, float(beta[0]), [float(beta[1]), float(beta[2])])


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> dict[str, str]:
    """Phrases of a term and a neighbouring word that stand in clean texts and in no toxic one."""

    def count(batches):
        import pyarrow as pa

        tool = Matcher(lexicon)
        for batch in batches:
            out: dict[tuple[str, str], list[int]] = {}
            for t, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist()):
                folded = fold(t)
                flat = f" {' '.join(folded)} "
                near = set()
                for place, term, _ in tool.hits(folded):
                    end = flat.index(" ", place + 1)
                    left, right = flat.rfind(" ", 0, place), flat.find(" ", end + 1)
                    if left >= 0:
                        near.add((flat[left : end + 1], term))
                    if right >= 0:
                        near.add((flat[place : right + 1], term))
                for key in near:
                    out.setdefault(key, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()),
                 pa.array([v[1] for v in out.values()], pa.int64()), pa.array([v[0] for v in out.values()], pa.int64())],
                names=["phrase", "term", "bad", "good"],
            )

    counted = rows.select("t", "y").mapInArrow(count, "phrase string, term string, bad bigint, good bigint").groupBy("phrase", "term")
    found = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where((F.col("bad") == 0) & (F.col("good") >= MIN_TEXTS))
    return {r["phrase"]: r["term"] for r in found.orderBy(F.desc("good"), "phrase", "term").limit(MAX_PHRASES).collect()}


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Score whole texts; result: `row`, `score` in 0..1, `n_hits`. Null and empty texts score as texts without hits."""

    def make():
        tool = Matcher(lexicon)

        def step(texts):
            got = [tool.score(t) for t in texts.to_pylist()]
            return [g[0] for g in got], [g[1] for g in got]

        return step

    return map_arrow(docs, {"t": docs[text]}, "score double, n_hits bigint", make, keep=keep)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn(docs, labels, eligible=fold_of(labels["doc_id"]) != 0)
    return score(docs, lexicon, keep=["doc_id"]).select(
        "row.doc_id",
        F.coalesce(fold_of(F.col("row.doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
