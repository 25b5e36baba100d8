"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight; none may be read more often than
``max_epochs`` times, and what a capped source cannot take is shared out again
by weight until no source is above its cap. Documents are then repeated: whole
repetitions for all of a source, one more for those whose seeded bucket lies
under the source's cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.llm.common import cut, word_count

#: Buckets into which a seeded hash deals documents: three hexadecimal digits.
BUCKETS = 4096


def bucket(id_col: Column, seed: int) -> Column:
    """A bucket from 0 to BUCKETS - 1: the first three hexadecimal digits of md5("seed:id")."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 3), 16, 10).cast("int")


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """``sources`` with ``rank``, from 0, by ``key`` in code point order, null last.

    Sorted by range partitions; a partition's first rank is the number of rows
    before it, so no task sees all rows.
    """
    at = cut(sources.orderBy(F.col(key).asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33).cast("int")
    before, seen = {}, 0
    for k, n in sorted((r[0], r[1]) for r in at.groupBy(part).count().collect()):
        before[k], seen = seen, seen + n
    pairs = [F.lit(x) for kv in before.items() for x in kv]
    first = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return at.withColumn("rank", first + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def water_level(sources: DataFrame, budget: float) -> float:
    """The level L with the sum of least(cap, weight * L) equal to ``budget``.

    Each round is one aggregation over the sources: those above their cap are
    clamped, and the rest share what is left. Infinite if all are clamped.
    """
    level, clamped = 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("cap"),
            F.coalesce(F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if row.n == clamped:
            return level
        if row.weight <= 0:
            return float("inf")
        level, clamped = (budget - row.cap) / row.weight, row.n


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, repeats, taken, and ``carry``.

    ``size`` is the number of words (0 for null). Sources in code point order,
    null last, have the ``weights`` over and over; together they share ``share``
    times all words, each at most ``max_epochs`` times its own. ``taken`` is
    ``repeats * size``. Of each source the buckets up to a cut are taken once
    more than the rest; the cut is where the words come nearest to the target.
    An equal input gives an equal result, whatever the partitions. Rows with
    one id share their bucket. A source without words has target 0.
    """
    size = word_count(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), bucket(F.col(id_col), seed).alias("bucket"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    base = cut(rows, "sizes")
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked(by_source, "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(sources, share * total)
    target = F.col("cap") if level == float("inf") else F.least("cap", F.col("weight") * F.lit(level))
    targets = sources.select("source", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))

    filled = base.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumnRenamed("source", "of")
    running = F.sum("words").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    filled = filled.withColumn("words", running).join(targets, F.col("of").eqNullSafe(F.col("source")))
    off = F.abs(F.col("words") - F.col("need"))
    cuts = filled.groupBy("source", "source_size", "target", "whole", "need").agg(F.min(F.struct(off.alias("off"), F.col("bucket"))).alias("best"))
    cuts = cuts.select(F.col("source").alias("of"), "source_size", "target", "whole", F.when(F.col("best.off") < F.col("need"), F.col("best.bucket")).otherwise(-1).alias("cut"))
    repeats = (F.col("whole") + (F.col("bucket") <= F.col("cut")).cast("int")).cast("int")
    return base.join(cuts, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"), *(F.col(f"carry_{c}").alias(c) for c in carry)
    )
