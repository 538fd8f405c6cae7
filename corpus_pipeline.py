"""Corpus pipeline: documents to token ids in five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage takes what its predecessor kept; all but the last return the columns of documents. Nulls, empty texts, repeated
rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm import byte_bpe, decontaminate, ngram_join, paragraphs, quality
from bundlewise.llm.common import ready, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or read unlike the trusted texts go (operator 6)."""
    ready(spark)
    weights, threshold = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, weights, threshold).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays (operator 3); a row stored twice stays once.

    Documents without words and those with a null id are in no group and stay.
    """
    ready(spark)
    found = ngram_join.near_duplicates(docs)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["_stays"]), "left_semi").dropDuplicates(["doc_id", "text"])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs and passages that repeat are removed but for the first of each (operator 1); rows stay, n_chars follows."""
    ready(spark)
    done = paragraphs.remove_repeats(docs, repeated_passages=True).select("row", F.col("text").alias("_kept"))
    new = {"text": F.col("_kept"), "n_chars": F.coalesce(F.char_length("_kept").cast("bigint"), F.col("row.n_chars"))}
    return done.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go (operator 8)."""
    ready(spark)
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("word_spans") == 0).select("row.*")


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left (operator 10): ids as little-endian unsigned 32-bit integers, and whether they decode to the text."""
    ready(spark)
    done = byte_bpe.encode(docs)
    return done.select(
        "row.doc_id", "row.lang", "row.source", "row.n_chars",
        F.floor(F.length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("exact"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: SQL expresses neither the hashed log-likelihood ratios nor byte-pair merges; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written once to the shared folder, as the next reads it often."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
