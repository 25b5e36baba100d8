"""Reuse of passages: which chunks repeat chunks of other documents, and a ledger of it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.text import content_hash
from siftloom.operators.search import nearest_others
from siftloom.session import ship

MIN_CHARS, NEAREST, MIN_COSINE, MIN_RATIO = 40, 5, 0.92, 0.7


def similarity(a: Column, b: Column) -> Column:
    """The ratio of matching characters of two texts, as difflib has it (asymmetric, with its rule for frequent characters)."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def reuse_events(new: DataFrame, stored: DataFrame, ledger: DataFrame | None = None, floor: float = MIN_COSINE, least: float = MIN_RATIO) -> DataFrame:
    """New events of reuse: new_chunk, new_document, content_hash, chunk_id, document_id, cos, ratio.

    new and stored: chunk_id, document_id, content, embedding. Short chunks
    don't count; of each new chunk the NEAREST vectors of other documents with
    at least ``floor`` are compared as texts. A chunk that is reused by a document
    in one content (``content_hash`` of the new chunk) is one event; what the ledger
    (new_document, content_hash, document_id, chunk_id) already has is left out.
    """
    ship(new.sparkSession)
    long = new.where(F.length(F.trim("content")) >= MIN_CHARS)
    asked = long.select(F.col("chunk_id").alias("query_id"), F.col("document_id").alias("query_document"), F.col("embedding").alias("vector"))
    near = nearest_others(stored, asked, NEAREST, floor)
    texts = near.join(long.select(F.col("chunk_id").alias("query_id"), F.col("document_id").alias("new_document"), F.col("content").alias("new_content"), content_hash(F.col("content")).alias("content_hash")), "query_id").join(stored.select("chunk_id", "content"), "chunk_id")
    met = texts.withColumn("ratio", F.round(similarity(F.col("new_content"), F.col("content")), 6)).where(F.col("ratio") >= least)
    keys = ["new_document", "content_hash", "document_id", "chunk_id"]
    best = met.groupBy(*keys).agg(F.max_by(F.struct(F.col("query_id").alias("new_chunk"), "cos", "ratio"), F.struct("ratio", "cos", "query_id")).alias("x")).select(*keys, "x.*")
    if ledger is not None:
        best = best.join(ledger.select(*keys), keys, "left_anti")
    return best.select("new_chunk", "new_document", "content_hash", "chunk_id", "document_id", "cos", "ratio")


def reuse_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("reuse_count"))
