"""Latent semantic vectors, learned from the texts themselves: a truncated SVD of weighted terms by random projections.

The matrix of texts and terms is never formed whole. It is written as sparse rows
once; each round multiplies it with a narrow matrix that is broadcast, and sums
of terms by that width come back, block by block. The driver holds numbers for
each term of a bounded vocabulary and each dimension, whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import sha256
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.operators.inrow import words
from siftloom.session import ship, written

#: Terms of the vocabulary at most, the most frequent of those in two texts or more; dimensions; dimensions more that a round carries, and rounds.
TERMS, RANK, MORE, ROUNDS = 20_000, 64, 16, 3
#: Rows that are multiplied at a time, and terms whose sums are one row of what comes back.
ROWS, BLOCK = 256, 500


@dataclass
class Space:
    """A vocabulary with weights and the basis (terms, dimensions); an encoder of texts to unit vectors."""

    terms: dict[bytes, int]
    idf: np.ndarray
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    singular: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def dim(self) -> int:
        return self.basis.shape[1]

    @property
    def model_id(self) -> str:
        """Names the space: vectors of different fits don't compare."""
        return f"latent-{self.dim}-{sha256(np.ascontiguousarray(self.basis)).hexdigest()[:12]}"

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text's terms: 1 + ln(tf) times idf, at length 1."""
        found = np.array([p for p in map(self.terms.get, words(text)) if p is not None], dtype=np.int64)
        at, tf = np.unique(found, return_counts=True)
        weights = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt((weights * weights).sum())
        return at, weights / norm if norm > 0 else weights

    def encode(self, texts: Sequence[str | None]) -> np.ndarray:
        """Unit vectors; a text without a known term has no length."""
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            at, weights = self.row(text)
            out[i] = weights @ self.basis[at]
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(norms > 1e-12, norms, np.inf)).astype(np.float32)


def vocabulary(texts: DataFrame, text_col: str = "content", limit: int = TERMS) -> Space:
    """The most frequent terms of two texts or more, with ln(n / df) + 1 as weight: at most ``limit``."""
    from siftloom.operators.search import terms

    n = texts.count()
    each = texts.select(F.explode(F.array_distinct(terms(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = each.where("df > 1").orderBy(F.desc("df"), "term").limit(limit).collect()
    return Space({r.term.encode(): i for i, r in enumerate(found)}, np.array([log(n / r.df) + 1 for r in found]))


def rows_of(texts: DataFrame, space: Space, text_col: str = "content") -> DataFrame:
    """The sparse rows of the matrix: at, weights; written."""
    spark = texts.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                found = [shared.value.row(t) for t in batch.column(0).slice(start, ROWS).to_pylist()]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(a) for a, _ in found])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0), *some]), kind, safe=False)) for some, kind in zip(zip(*found, strict=True), (pa.int32(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(lists, ["at", "weights"])

    return written(texts.select(text_col).mapInArrow(run, "at array<int>, weights array<double>"), "rows")


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the matrices (block, data) that come sorted by block, of which one sum and one matrix are held at a time."""
    now, total = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            block, part = batch.column("block")[i].as_py(), np.frombuffer(batch.column("data")[i].as_buffer())
            if block != now:
                if now is not None:
                    yield _block(now, total)
                now, total = block, np.zeros(len(part))
            total += part
    if now is not None:
        yield _block(now, total)


def _block(block: int, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([numbers.tobytes()], pa.binary())], ["block", "data"])


def _summed(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum over tasks of the matrices whose blocks ``make`` gives (block, data): blocks meet by a shuffle, and each is added up as it streams by."""
    schema = "block int, data binary"
    out = np.zeros(shape)
    for r in rows.mapInArrow(make, schema).repartition("block").sortWithinPartitions("block").mapInArrow(added, schema).collect():  # the matrix itself
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.data).reshape(-1, shape[1])
    return out


def squared(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """The matrix's transpose times the matrix times ``q`` (terms, width)."""
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        total, any_ = np.zeros_like(q), False
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                at, weights = (part.column(c).flatten().to_numpy() for c in ("at", "weights"))
                if not len(at):
                    continue
                own, column = np.unique(at, return_inverse=True)
                dense = np.zeros((part.num_rows, len(own)))
                dense[np.repeat(np.arange(part.num_rows), part.column("at").value_lengths().to_numpy(zero_copy_only=False)), column] = weights
                total[own] += dense.T @ (dense @ q[own])
                any_ = True
        if any_:
            for b in range(0, len(total), BLOCK):
                yield _block(b // BLOCK, total[b : b + BLOCK])

    return _summed(run, rows, q.shape)


def fit(texts: DataFrame, text_col: str = "content", limit: int = TERMS, rank: int = RANK, rounds: int = ROUNDS, seed: int = 5) -> Space:
    """The space of the texts: its vocabulary, and the ``rank`` directions of the greatest singular values (fewer if there are fewer terms).

    A text counts once, null and empty ones as nothing. Without a term that two
    texts share the space has no dimensions.
    """
    space = vocabulary(texts, text_col, limit)
    n = len(space.terms)
    width = min(n, rank + MORE)
    if not n:
        return space
    rows = rows_of(texts, space, text_col)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(squared(rows, q))[0]
    values, turn = np.linalg.eigh(q.T @ squared(rows, q))
    best = np.argsort(-values)[: min(rank, n)]
    basis = q @ turn[:, best]
    basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(len(best))] < 0, -1, 1)  # signs are free: the largest entry is positive
    return Space(space.terms, space.idf, basis, np.sqrt(np.maximum(values[best], 0)))


def embedded(texts: DataFrame, space: Space, text_col: str = "content") -> DataFrame:
    """The rows with ``embedding``, the unit vector of their text."""
    from siftloom.sources.sinks import embedded as with_vectors

    return with_vectors(texts, space, text_col)
