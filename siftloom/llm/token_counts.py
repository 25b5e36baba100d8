"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their encoded length once; sums over the lengths
from each one up then answer totals, quantiles and truncated totals for every
context limit without looking at a document again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.llm.bpe import broadcast_vocabulary, codec_of, encoded_batches
from siftloom.llm.common import cut, small_batches

#: Lengths that share a block of the running sums; a block has as many rows at most.
BLOCK = 128


def encoded_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id and n_tokens of the whole text; 0 for null and empty texts."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = broadcast_vocabulary(spark, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ids in encoded_batches(codec_of(shared), batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, ids), pa.int64())], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """The distinct lengths with what every limit needs; null lengths are left out.

    Columns: n_tokens, n_docs (of that length), docs_from and tokens_from (of
    that length or longer), docs_below and tokens_below (shorter), and
    truncated_total (tokens kept if every document is cut at this length). The
    suffix sums run within blocks of BLOCK lengths, with the sums of the blocks
    above added, so no task holds more than one block or one row per block.
    """
    counts = lengths.select(F.col(length_col).cast("long").alias("n_tokens")).where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = cut(counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "lengths")
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(tokens).alias("block_tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(every).alias("docs"),
        F.sum("block_tokens").over(every).alias("tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumns({"docs_in": F.sum("n_docs").over(within), "tokens_in": F.sum(tokens).over(within)}).join(blocks, "block")
    sums = sums.withColumns({"docs_from": F.col("docs_in") + F.col("docs_above"), "tokens_from": F.col("tokens_in") + F.col("tokens_above")})
    sums = sums.withColumns({"docs_below": F.col("docs") - F.col("docs_from"), "tokens_below": F.col("tokens") - F.col("tokens_from")})
    kept = F.col("tokens_below") + F.col("docs_from") * F.col("n_tokens")
    return sums.select("n_tokens", "n_docs", "docs_from", "tokens_from", "docs_below", "tokens_below", kept.alias("truncated_total"))


def limit_rows(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: limit, docs_from, docs_below, tokens_from, tokens_below and truncated_total.

    Answered by the sums of the least length that is no shorter, or, where
    every document is shorter, by the sums of all; an empty histogram gives zeros.
    """
    told = F.struct("n_tokens", "docs_from", "docs_below", "tokens_from", "tokens_below")
    each = [F.struct(F.lit(int(x)).cast("long").alias("limit"), F.min(F.when(F.col("n_tokens") >= int(x), told)).alias("x")) for x in limits]
    every = [F.coalesce(F.max(F.col(f"{k}_from") + F.col(f"{k}_below")), F.lit(0)).alias(k) for k in ("docs", "tokens")]
    rows = histogram.agg(F.array(*each).alias("each"), *every).select("docs", "tokens", F.inline("each"))
    above = {f"{k}_from": F.coalesce(f"x.{k}_from", F.lit(0)) for k in ("docs", "tokens")}
    below = {f"{k}_below": F.coalesce(f"x.{k}_below", k) for k in ("docs", "tokens")}
    rows = rows.withColumns(above | below)
    return rows.select("limit", *above, *below, (F.col("tokens_below") + F.col("docs_from") * F.col("limit")).alias("truncated_total"))


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: total and truncated tokens, and how many documents exceed it; zeros without documents."""
    cut_at = limit_rows(histogram, limits)
    over = limit_rows(histogram, [x + 1 for x in limits]).select((F.col("limit") - 1).alias("limit"), F.col("docs_from").alias("docs_over"))
    total = (F.col("tokens_from") + F.col("tokens_below")).alias("total")
    return cut_at.select("limit", total, "truncated_total").join(F.broadcast(over), "limit").select("limit", "total", "truncated_total", "docs_over")  # a row a limit


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """For each share q the least length L such that at least q of the documents are no longer than L; null without documents."""
    total = F.sum("n_docs")
    upto = F.col("docs_below") + F.col("n_docs")
    docs = histogram.agg(total.alias("docs"))
    rows = histogram.crossJoin(F.broadcast(docs))  # one row beside the histogram
    each = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(upto >= F.lit(float(q)) * F.col("docs"), F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return rows.agg(F.array(*each).alias("each")).select(F.inline("each"))


def token_report(histogram: DataFrame, limits: Sequence[int], shares: Sequence[float]) -> DataFrame:
    """The histogram (kind ``length``) with rows for context limits (``limit``) and quantiles (``quantile``, with their share).

    ``n_tokens`` is the length, the limit or the quantile; sums are those of the
    histogram. Quantiles have no sums.
    """
    histogram = cut(histogram, "histogram")
    at = limit_rows(histogram, limits).withColumnRenamed("limit", "n_tokens").withColumn("kind", F.lit("limit"))
    shared = quantiles(histogram, shares).withColumn("kind", F.lit("quantile"))
    rows = histogram.withColumn("kind", F.lit("length")).unionByName(at, allowMissingColumns=True).unionByName(shared, allowMissingColumns=True)
    return rows.select("kind", "share", "n_tokens", "n_docs", "docs_from", "tokens_from", "docs_below", "tokens_below", "truncated_total")
