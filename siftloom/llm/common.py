"""Helpers that the operators of this subpackage share.

Words everywhere in this subpackage are maximal runs of characters other than
the six ASCII white-space characters (space and U+0009 to U+000D).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.session import ship

#: One word, and one run of what separates words; both read alike in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows that an Arrow batch holds at most, so that a batch of long texts stays small.
BATCH_ROWS = 250


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session has none (tests, a laptop) a folder under the
    temporary directory stands in for it. Raises ValueError on a cluster
    without one, whose machines share no temporary folder.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    return "file://" + os.path.join(tempfile.gettempdir(), "siftloom-checkpoints")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def cut(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage and computes ``df`` once; a lost executor costs only the
    tasks that it ran, since the files are in shared storage.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Send the package to the workers, and bound the rows of an Arrow batch, unless the session's bound is lower."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def byte_batches(spark: SparkSession, size: str = "4m") -> None:
    """Like :func:`small_batches`, with a bound of bytes in place of one of rows, so that batches of short rows stay large."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == BATCH_ROWS:
        spark.conf.unset(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def word_count(text: str | Column) -> Column:
    """Number of words as long; null counts as a text without words."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")
