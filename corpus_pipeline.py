"""The corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage takes what its predecessor kept and returns rows of ``documents``;
the last returns token digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.llm import bpe, mixing, ngram_join, quality_classifier, secret_scan, url_filter
from siftloom.llm.common import cut, table
from siftloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Near-duplicate stages take five words and a similarity of 0.8 or more.
SHINGLE_WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: each row by its own text, whatever its id; nothing is shuffled."""
    model = quality_classifier.learned(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.with_scores(docs.select(*COLUMNS), model)
    return scored.where(F.col("score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays; documents without words or id stay.

    Texts that stay are not shuffled, but for a few that a filter of ids mistakes.
    """
    found = ngram_join.jaccard_classes(docs, n=SHINGLE_WORDS, percent=PERCENT, counted=False)
    gone = cut(found.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    return url_filter.without_ids(docs.select(*COLUMNS), gone)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays. Null and empty texts stay as they are."""
    return secret_scan.redact(docs, path_col="source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as the mix takes them; those that it doesn't take go. Null and empty texts have size 0 and are repeated as their bucket is."""
    taken = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    return taken.where("repeats > 0").select("doc_id", "text", "lang", "source", "n_chars", F.explode(F.sequence(F.lit(1), "repeats")).alias("nth")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens, as the BPE query has them; null and empty texts have none."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: SQL cannot express the classifier, the forest or BPE; a test replays the stages by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
