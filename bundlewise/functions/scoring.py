"""Vector and keyword scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bundlewise.functions.rounding import round_exact

# fixed values: weights and thresholds of the case score
HIT_WEIGHT = 0.7
CLEAN_WEIGHT = 0.3
PASS_SCORE = 0.7
DELTA_THRESHOLD = 0.05


def _total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(_total(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def unit(vector: Column) -> Column:
    """Vector of length one; an all-zero vector stays zero."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 for missing, empty, differently long or all-zero vectors."""
    dot = _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    scale = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(usable, dot / scale).otherwise(0.0)


def keyword_scores(text: Column, expected: Column, anti: Column) -> Column:
    """Struct of hit ratio, clean ratio, blended score, missed and violating keywords; substring, case ignored.

    An empty list counts as ratio 0, so without anti keywords the blend tops out at the hit weight.
    """
    low = F.lower(text)

    def found(keys: Column, yes: bool) -> Column:
        return F.filter(keys, lambda k: F.contains(low, F.lower(k)) if yes else ~F.contains(low, F.lower(k)))

    def ratio(part: Column, whole: Column) -> Column:
        return F.size(part) / F.greatest(F.size(whole), F.lit(1))

    hit = ratio(found(expected, True), expected)
    clean = ratio(found(anti, False), anti)
    return F.struct(
        round_exact(hit, 3).alias("keyword_hit"),
        round_exact(clean, 3).alias("anti_clean"),
        round_exact(F.lit(HIT_WEIGHT) * hit + F.lit(CLEAN_WEIGHT) * clean, 3).alias("keyword_score"),
        found(expected, False).alias("missed_keywords"),
        found(anti, True).alias("anti_violations"),
    )


def blended_score(mode: str, keyword_score: Column, embedding_score: Column) -> Column:
    """Case score by mode; `both` falls back to keywords where there is no embedding score."""
    if mode == "keyword":
        return keyword_score
    if mode == "embedding":
        return F.coalesce(embedding_score, F.lit(0.0))
    if mode != "both":
        raise ValueError(f"unknown scoring mode: {mode}")
    return F.when(embedding_score.isNull(), keyword_score).otherwise(
        round_exact(F.lit(0.5) * keyword_score + F.lit(0.5) * embedding_score, 3)
    )
