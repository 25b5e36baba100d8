"""Running sums and maxima over keys of any size.

A window over a key is one task, however many rows the key has. Here rows are
dealt by ranges of their order first, so that a key with very many rows spans
several ranges; each range is scanned by itself, a row a key and range tells
what came before, and is added. Only these few rows of a key meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from siftloom.session import written


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``_range``, the number of their range in the order of keys and ``order``; written, so that ranges stay what they are."""
    return written(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _own(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "_range").orderBy(*order)


def _met(rows: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of ``few``, a row a key and range."""
    renamed = few.select(*(F.col(c).alias(f"_of_{c}") if c in (*keys, "_range") else F.col(c) for c in few.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, "_range")]
    return rows.join(renamed, same).drop(*(f"_of_{c}" for c in (*keys, "_range")))


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Ranged rows with the sum of ``value`` of a key's rows up to each one; null values count 0, rows that tie in the order are taken in any."""
    within = _own(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    valued = rows.withColumn("_value", F.coalesce(value, F.lit(0)))
    sums = valued.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    told = _met(valued.withColumn("_within", F.sum("_value").over(within)), sums, keys)
    return told.withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within", "_value")


def greatest_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranged rows with the greatest ``value`` of a key's rows before each one; null for the first."""
    back = (Window.unboundedPreceding, -1)
    most = rows.groupBy(*keys, "_range").agg(F.max(value).alias("_most"))
    most = most.select(*keys, "_range", F.max("_most").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(*back)).alias("_before"))
    told = _met(rows.withColumn("_within", F.max(value).over(_own(keys, order).rowsBetween(*back))), most, keys)
    return told.withColumn(name, F.greatest("_before", "_within")).drop("_before", "_within")


def floored_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """A row a key: where a walk from 0 by ``value`` in order ends that never falls below 0.

    A range is a function of where it starts: it adds its sum, and ends no lower
    than its sum less its lowest partial sum. Such functions follow one another
    without looking at rows again.
    """
    ranges = ranged(rows.select(*keys, *order, value), keys, order)
    within = _own(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    steps = ranges.withColumn("_walk", F.sum(value).over(within)).groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"), F.min("_walk").alias("_low"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lows = steps.withColumn("_low", before + F.col("_low")).groupBy(*keys).agg(F.sum("_sum").alias("_sum"), F.min("_low").alias("_low"))
    return lows.select(*keys, (F.col("_sum") - F.least(F.lit(0), F.col("_low"))).alias(name))
