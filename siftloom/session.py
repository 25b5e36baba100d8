"""What executors need to run this package's Python parts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that Spark hands to Python at most, so that a worker's memory does not follow the width of the rows.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors through Spark, once for each application; they need no copy of their own. Bounds the session's Arrow batches, unless its bound is lower."""
    context = spark.sparkContext
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    if getattr(context, "_siftloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="siftloom-")  # the driver serves it to executors as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "siftloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    context.addPyFile(str(path))
    context._siftloom_shipped = True


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all machines share, ``spark.checkpoint.dir``; it stays.

    Where a local session has none a folder under the temporary directory stands
    in for it. Raises ValueError on a cluster without one.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        told = "file://" + tempfile.gettempdir() + "/siftloom-checkpoints"
    return f"{told.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, and no task depends on how it came about. It goes when the driver's JVM ends."""
    path = shared_folder(df.sparkSession, tag)
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where keys meet, about.
DEALT = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by hash of the keys over as many tasks as its rows need, so that what a task sorts or groups does not grow; meant for stored tables, whose rows are counted by their footers.

    Left to itself Spark puts partitions together by their compressed bytes, which short keys have few of.
    """
    tasks = max(-(-df.count() // DEALT), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)
