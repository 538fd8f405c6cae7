"""Language identification by words first: known words count by their log frequency in each language, unseen words fall
back to progressively shorter character n-grams.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm.common import map_arrow, table

#: Size of a model: words and n-grams known at most, the most frequent ones; all others count as unseen.
MAX_WORDS, MAX_GRAMS = 100_000, 60_000
#: Numbers in the frequency table of either kind; with very many languages fewer words are known.
MAX_CELLS = 4_000_000
#: A known word stands in the corpus at least so often, and is no longer than this.
MIN_COUNT, MAX_LETTERS = 2, 40
#: Lengths of the n-grams of an unseen word (its ends count as characters), in the order they are tried.
SIZES = (5, 4, 3, 2, 1)
#: Counts are passed on when a task holds so many.
FLUSH = 300_000
UNKNOWN = "und"

_RUN = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Words: runs of letters, lower-cased and composed. Other digits and marks part words."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    found = _RUN.findall(text.lower())
    if text.isascii() or "".join(found).isalpha():
        return found
    # number signs such as ² or Ⅷ are word characters but no letters
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


def grams(word: str, size: int) -> list[str]:
    """Character n-grams of a word with its ends marked; single characters without the marks."""
    if size == 1:
        return list(word)
    marked = f" {word} "
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


@dataclass
class Model:
    """Log frequencies: `table` has a column for each language and a row for each known word and n-gram."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    usual: int  # the language with the most words

    def pieces(self, word: str) -> list[int]:
        """Rows of the longest n-grams of an unseen word that are known."""
        for size in SIZES:
            known = [i for i in map(self.grams.get, grams(word, size)) if i is not None]
            if known:
                return known
        return []

    def predict(self, text: str | None, unseen: dict[str, list[int]]) -> tuple[str, float]:
        """(language, score). A word counts with its log frequency, an unseen one with the mean of its n-grams.

        Evidence grows with the root of the words counted: neighbouring words depend on one another. `unseen` keeps the
        rows of unseen words for the texts to come.
        """
        found = letters(text or "")
        if not found or not self.languages:
            return UNKNOWN, 0.0
        rows: list[int] = []
        weights: list[float] = []
        n = 0
        for w, times in Counter(found).items():
            at = self.words.get(w)
            if at is not None:
                rows.append(at)
                weights.append(times)
            else:
                own = unseen.get(w)
                if own is None:
                    if len(unseen) >= FLUSH:
                        unseen.clear()
                    own = unseen[w] = self.pieces(w)
                if not own:
                    continue
                rows += own
                weights += [times / len(own)] * len(own)
            n += times
        if not n:
            return self.languages[self.usual], 1.0 / len(self.languages)
        z = (np.array(weights) @ self.table[rows]) / np.sqrt(n)
        p = np.exp(z - z.max())
        best = int(np.argmax(z))
        return self.languages[best], float(p[best] / p.sum())


def word_counts(docs: DataFrame, lang: str, text: str, learn: Column) -> DataFrame:
    """(word, lang, n) over whole texts; counted in each task first, so a frequent word is one row of it."""

    def count(batches):
        held: dict[str, Counter] = {}
        size = 0

        def out():
            rows = [(w, k, n) for k, own in held.items() for w, n in own.items()]
            arrays = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "lang", "n"])

        for batch in batches:
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                own = held.setdefault(k, Counter())
                before = len(own)
                own.update(letters(t))
                size += len(own) - before
                if size > FLUSH:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    rows = docs.where(F.coalesce(learn, F.lit(False)) & docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[lang].cast("string").alias("k"), docs[text].alias("t"))
    return rows.mapInArrow(count, "word string, lang string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def _gram_counts(counted: DataFrame) -> DataFrame:
    """(gram, lang, n) of all counted words, each word as often as it stands."""

    def cut(batches):
        for batch in batches:
            held: dict[tuple[str, str], int] = {}
            for w, k, n in zip(*[batch.column(c).to_pylist() for c in ("word", "lang", "n")]):
                for size in SIZES:
                    for g in grams(w, size):
                        held[g, k] = held.get((g, k), 0) + n
            arrays = [pa.array([g for g, _ in held], pa.string()), pa.array([k for _, k in held], pa.string()), pa.array(list(held.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["gram", "lang", "n"])

    return counted.mapInArrow(cut, "gram string, lang string, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def _log_table(counted: DataFrame, key: str, languages: list[str], limit: int, groups: Column) -> tuple[list[str], np.ndarray]:
    """The most frequent keys and the log of their smoothed share of all that a language holds in the same group.

    Keys are cut at a frequency: steps of a percent are counted, and the lowest step that does not fit into `limit` whole
    is left out with all below it. So no more than `limit` keys are sent, and none is chosen among equals.
    """
    limit = max(1, min(limit, MAX_CELLS // max(len(languages), 1)))
    step = F.floor(F.log("n") * 100).cast("bigint")
    whole = counted.groupBy(key).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.first(groups).alias("g"))
    whole = whole.where(F.col("n") >= MIN_COUNT).withColumn("step", step)
    bar, room = 0, limit
    for r in whole.groupBy("step").agg(F.count("*").alias("keys")).orderBy(F.desc("step")).collect():
        if r["keys"] > room:
            bar = r["step"] + 1
            break
        room -= r["keys"]
    by = F.array(*[F.coalesce(F.try_element_at("by", F.lit(k)), F.lit(0)) for k in languages]) if languages else F.expr("cast(array() as array<bigint>)")
    rows = whole.where(F.col("step") >= bar).select(F.col(key).alias("key"), "g", by.alias("own")).toArrow().sort_by("key")
    totals = {(r["g"], r["lang"]): r["n"] for r in counted.groupBy(groups.alias("g"), "lang").agg(F.sum("n").alias("n")).collect()}
    keys, group = rows.column("key").to_pylist(), rows.column("g").to_numpy()
    own = rows.column("own").combine_chunks().flatten().to_numpy().reshape(len(keys), len(languages)).astype(float) if keys else np.zeros((0, len(languages)))
    for g in set(group.tolist()):
        inside = group == g
        # half an occurrence for each key and language: a word that one language lacks is not impossible there
        base = np.array([totals.get((g, k), 0) for k in languages]) + 0.5 * (inside.sum() + 1)
        own[inside] = np.log((own[inside] + 0.5) / base)
    return keys, own.astype(np.float32)


def learn(
    docs: DataFrame, lang: str = "lang", text: str = "text", eligible: Column | None = None, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS
) -> Model:
    """Count the words and n-grams of all eligible whole texts and keep the most frequent ones.

    `eligible` is a condition on `docs`; null: not learned from. Null languages and texts are no examples. Counts cover all
    texts; only the model (at most `max_words` and `max_grams` rows, the most frequent) reaches the driver. Without examples
    the model has no language.
    """
    counted = word_counts(docs, lang, text, F.lit(True) if eligible is None else eligible).persist()
    short = counted.where(F.length("word") <= MAX_LETTERS)
    pieces = _gram_counts(short).persist()
    try:
        per = counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()
        languages = [r["lang"] for r in per]
        words, word_table = _log_table(short, "word", languages, max_words, F.lit(0))
        known, gram_table = _log_table(pieces, "gram", languages, max_grams, F.length("gram"))
    finally:
        pieces.unpersist()
        counted.unpersist()
    return Model(
        languages, {w: i for i, w in enumerate(words)}, {g: len(words) + i for i, g in enumerate(known)},
        np.vstack([word_table, gram_table]), int(np.argmax([r["n"] for r in per])) if per else 0,
    )


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`row`, `lang_pred`, `score` in 0..1 for every whole text.

    A null text, one without a letter, and every text under a model without languages are `und` with score 0. Where no
    word and no n-gram is known the language with the most words is given, with the score of a guess. Equal languages: the
    first in order. Repeated rows get equal results; extra columns stay untouched in `row`.
    """
    # bounded by MAX_WORDS, MAX_GRAMS and MAX_CELLS; plain values, so that workers need no copy of this package to read it
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        tool, unseen = Model(**shared.value), {}

        def step(texts):
            got = [tool.predict(t, unseen) for t in texts.to_pylist()]
            return [g[0] for g in got], [g[1] for g in got]

        return step

    return map_arrow(docs, {"t": docs[text]}, "lang_pred string, score double", make, keep=keep)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, eligible=fold_of(docs["doc_id"]) != 2)
    return identify(docs, model, keep=["doc_id"]).select(
        "row.doc_id", F.coalesce(fold_of(F.col("row.doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
