import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from siftloom.plans import registry
print("ROWS", registry.QUERIES["chunk_by_sentences"](spark, "/root/testdata/sf0.001").count())
"""


def test_executors_need_no_copy(tmp_path):
    """Run from another folder, so that workers find the package only as it was sent."""
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=200)
    assert int(done.stdout.rpartition("ROWS ")[2]) > 0, done.stderr[-2000:]


def test_arrow_batches_are_bounded_by_bytes(spark):
    """64 rows of a megabyte reach Python a few at a time; a lower bound of the session stays."""
    from pyspark.sql import functions as F

    from siftloom.session import ship

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    try:
        spark.conf.unset(key)
        ship(spark)
        rows = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) == 64 and max(found) <= 9
        spark.conf.set(key, "1m")
        ship(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
