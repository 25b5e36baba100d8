"""Sinks: partitioned tables whose writes can be repeated, and vectors from an encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions.text import chunk_uuid
from siftloom.session import ship

#: Rows that are given their vectors at a time.
ROWS = 256


def write_partitions(rows: DataFrame, path: str, by: Sequence[str] = ("workspace_id",)) -> None:
    """Replaces just the partitions that ``rows`` has; a repeated write gives the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the rows whose keys the table at ``path`` lacks, each key once; without a table all of them are its first.

    Of the table only the keys are read. A repeated append adds nothing.
    """
    from siftloom.operators.tables import appended

    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    stored = spark.read.schema(rows.schema).parquet(path) if there else rows.limit(0)
    appended(stored, rows, keys).write.mode("append").parquet(path)


class Encoder(Protocol):
    """What turns texts into vectors; ``model_id`` and ``dim`` name the space."""

    model_id: str
    dim: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEncoder:
    """An offline encoder: signed feature hashing of words, unit length. Of our own making; no trained model is at hand."""

    def __init__(self, dim: int = 64):
        self.dim, self.model_id = dim, f"hashing-{dim}"

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def embedded(rows: DataFrame, encoder: Encoder, text_col: str = "content", batch: int = 32) -> DataFrame:
    """``rows`` with ``embedding``; null and blank texts have the zero vector."""
    ship(rows.sparkSession)
    schema = f"{rows.schema.simpleString()[7:-1]}, embedding: array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                part = whole.slice(start, ROWS)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                out = np.zeros((len(texts), encoder.dim), dtype=np.float32)
                full = [i for i, t in enumerate(texts) if t and t.strip()]
                for at in range(0, len(full), batch):
                    out[full[at : at + batch]] = encoder.encode([texts[i] for i in full[at : at + batch]])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * encoder.dim, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "embedding"])

    return rows.mapInArrow(run, schema)


def check_identity(stamp: dict | None, encoder: Encoder) -> dict:
    """The collection's stamp, adopted where it has none. Raises ValueError if it names another space."""
    own = {"model_id": encoder.model_id, "dim": encoder.dim}
    if stamp and stamp != own:
        raise ValueError(f"the collection holds {stamp}, not {own}")
    return own


def vector_rows(chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """Chunks (workspace_id, user_id, document_id, chunk_index, content) with deterministic ids and vectors, ready to be written."""
    keyed = chunks.withColumn("vector_id", chunk_uuid("workspace_id", "user_id", "document_id", F.col("chunk_index")))
    return embedded(keyed, encoder)
