"""Tables laid out for lookups: partitioned by workspace and by a hash of the document, with Bloom filters of its id.

A lookup of one document reads the files of one bucket of one workspace, and of
these only row groups whose filter may hold the id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files at most that a bucket's rows are spread over, so that a document with very many rows is no single task.
SLICES = 8


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def put(rows: DataFrame, path: str, key: str = "document_id", scope: str = "workspace_id", order: Sequence[str] = (), buckets: int = 64) -> None:
    """Write rows at ``path``; buckets of workspaces that are there already are replaced, others stay, so a repeated write changes nothing.

    ``buckets`` is fixed by the first write: a table is read by the number it was
    written with. Rows without a workspace or key can be looked up by neither.
    """
    spark = rows.sparkSession
    bucketed = rows.withColumn("bucket", _bucket(F.col(key), buckets))
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SLICES))
    sorted_ = bucketed.repartition(scope, "bucket", spread).sortWithinPartitions(scope, "bucket", key, *order)
    writer = sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.partitionBy(scope, "bucket").parquet(f"{path}/rows")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


def read(spark: SparkSession, path: str, workspace: object, scope: str = "workspace_id") -> DataFrame:
    """The rows of a workspace: only its partitions are read. Raises ValueError for a blank one rather than widening the search."""
    if workspace is None or not str(workspace).strip():
        raise ValueError("a workspace must be named")
    return spark.read.parquet(f"{path}/rows").where(F.col(scope) == F.lit(workspace)).drop("bucket")


def of_document(spark: SparkSession, path: str, workspace: object, document_id: object, key: str = "document_id", scope: str = "workspace_id") -> DataFrame:
    """The rows of one document of a workspace; a null id has none."""
    buckets = spark.read.parquet(f"{path}/layout").first()[0]
    rows = spark.read.parquet(f"{path}/rows").where((F.col("bucket") == _bucket(F.lit(document_id), buckets)) & (F.col(key) == F.lit(document_id)))
    if workspace is None or not str(workspace).strip():
        raise ValueError("a workspace must be named")
    return rows.where(F.col(scope) == F.lit(workspace)).drop("bucket")


def of_documents(spark: SparkSession, path: str, workspace: object, ids: DataFrame, key: str = "document_id", scope: str = "workspace_id") -> DataFrame:
    """The rows of a workspace's documents whose ids a table holds; each once, whatever the ids repeat."""
    return read(spark, path, workspace, scope).join(ids.select(key).distinct(), key, "left_semi")
