"""Stated queries against every row in the task that reads the row: term and vector scores as matrix products, with k rows a query kept.

Queries of a checked size are broadcast; texts, postings and pairs are not
shuffled, only the best rows of each task. The callers join by shuffle where
the queries are too large for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.session import ship

#: Bytes of the queries that are collected and broadcast at most.
MAX_BYTES = 32 << 20
#: Rows, queries and terms of them that are multiplied at a time.
ROWS, QUERIES, TERMS = 256, 512, 20_000
#: Tables of rows that are held at most; ones of few rows take more memory than their rows.
HELD = 500

_KEPT = bytes.maketrans(bytes(x for x in range(256) if not (48 <= x <= 57 or 97 <= x <= 122)), b" " * (256 - 36))


def fits(queries: DataFrame, column: str) -> bool:
    """Whether a column of texts or vectors is within MAX_BYTES, by one aggregation."""
    kind = queries.schema[column].dataType
    size = F.octet_length(column) if isinstance(kind, T.StringType) else 8 * F.size(column)
    return (queries.agg(F.sum(F.coalesce(size, F.lit(0)) + 32)).first()[0] or 0) <= MAX_BYTES


def words(text: str | None) -> list[bytes]:
    """The lower-case ASCII words and numbers, in order."""
    return text.lower().encode("utf-8", "replace").translate(_KEPT).split() if text else []


@dataclass
class Asked:
    """Queries by their distinct terms: ids, the vocabulary, and the places of each one's terms in it."""

    ids: pa.Array
    places: dict[bytes, int]
    terms: list[np.ndarray]

    @classmethod
    def of(cls, queries: DataFrame, query_col: str = "query", chosen: Callable[[bytes], bool] | None = None) -> Asked:
        """The queries of a checked size; ``chosen`` tells which of their words count."""
        table = queries.select("query_id", query_col).toArrow().combine_chunks()
        places: dict[bytes, int] = {}
        terms = []
        for text in table.column(query_col).to_pylist():
            own = dict.fromkeys(w for w in words(text) if chosen is None or chosen(w))
            terms.append(np.array([places.setdefault(w, len(places)) for w in own], dtype=np.int64))
        ids = table.column("query_id")
        return cls(ids.chunk(0) if ids.num_chunks else pa.array([], ids.type), places, terms)

    @cached_property
    def blocks(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For some queries at a time: the first one's place, the terms that they have, and which has which as (terms, queries)."""
        edges, n = [0], 0
        for i, t in enumerate(self.terms):
            if i > edges[-1] and (i - edges[-1] >= QUERIES or n + len(t) > TERMS):
                edges.append(i)
                n = 0
            n += len(t)
        out = []
        for at, end in zip(edges, [*edges[1:], len(self.terms)], strict=True):
            some = self.terms[at:end]
            own = np.unique(np.concatenate(some)) if some else np.empty(0, np.int64)
            member = np.zeros((len(own), len(some)))
            for q, t in enumerate(some):
                member[np.searchsorted(own, t), q] = 1
            out.append((at, own, member))
        return out


@dataclass
class Counted:
    """How often texts have the asked terms: for each such pair the text's row, the term's place and the count; and the texts' lengths in words."""

    row: np.ndarray
    place: np.ndarray
    tf: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], asked: Asked) -> Counted:
        get = asked.places.get
        lengths, at = np.zeros(len(texts)), []
        for i, text in enumerate(texts):
            found = words(text)
            lengths[i] = len(found)
            own = np.array([p for p in map(get, found) if p is not None], dtype=np.int64)
            at.append(own + i * len(asked.places))
        pairs, tf = np.unique(np.concatenate(at), return_counts=True) if at else (np.empty(0, np.int64),) * 2
        row, place = np.divmod(pairs, max(len(asked.places), 1))
        return cls(row, place, tf.astype(np.float64), lengths)

    def dense(self, own: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values of the pairs as (texts, terms) for the terms ``own``."""
        out = np.zeros((len(self.lengths), len(own)))
        if len(own):
            column = np.minimum(np.searchsorted(own, self.place), len(own) - 1)
            has = own[column] == self.place
            out[self.row[has], column[has]] = values[has]
        return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits


class Best:
    """The k best rows of each query that a task has met: by score, then by the first carried column."""

    def __init__(self, n_queries: int, k: int, carried: pa.Schema):
        self.k, self.carried = k, carried
        self.least = np.full(n_queries, -np.inf)
        self.held: list[pa.Table] = []
        self.rows = 0

    def add(self, at: int, scores: np.ndarray, met: np.ndarray, rows: pa.Table) -> None:
        """Scores (rows, queries) of queries from place ``at`` on; only pairs that ``met`` count."""
        scores = np.where(met, scores, -np.inf)
        n, m = scores.shape
        floor = self.least[at : at + m]
        if n > self.k:
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=0)[n - self.k])
        row, q = np.nonzero((scores >= floor) & met)
        if len(row):
            told = rows.take(pa.array(row))
            self.held.append(told.append_column("_q", pa.array(q + at, pa.int64())).append_column("score", pa.array(scores[row, q], pa.float64())))
            self.rows += len(row)
        if self.rows > max(4 * self.k * len(self.least), 100_000) or len(self.held) > HELD:
            self._prune()

    def _prune(self) -> None:
        table = pa.concat_tables(self.held)
        table = table.sort_by([("_q", "ascending"), ("score", "descending"), (self.carried.names[0], "ascending")])
        q = table.column("_q").to_numpy()
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(nth == self.k - 1)
        self.least[q[last]] = table.column("score").to_numpy()[last]
        kept = table.filter(pa.array(nth < self.k)).combine_chunks()
        self.held, self.rows = [kept], kept.num_rows

    def result(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._prune()
            table = self.held[0].combine_chunks()
            told = ids.take(table.column("_q").combine_chunks())
            out = pa.table([told, *(table.column(c) for c in self.carried.names), table.column("score")], ["query_id", *self.carried.names, "score"])
            yield from out.to_batches()


def scored_rows(rows: DataFrame, read: str, carried: list[str], ids: pa.Array, id_type: T.DataType, k: int, score: Callable[[pa.Array], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """The best rows of each task: query_id, the carried columns and score. ``score`` gives blocks of scores and of pairs that count, for values of ``read``."""
    ship(rows.sparkSession)
    rows = rows.select(*carried, read)
    n_queries = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = pa.Table.from_batches([batch.slice(at, ROWS)])
                own = part.select(carried)
                best = best or Best(n_queries, k, own.schema)
                for place, scores, met in score(part.column(read).combine_chunks()):
                    best.add(place, scores, met, own)
        if best is not None:
            yield from best.result(ids)

    schema = T.StructType([T.StructField("query_id", id_type), *rows.select(*carried).schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def term_statistics(chunks: DataFrame, asked: Asked, text_col: str = "content") -> tuple[int, float, np.ndarray]:
    """The number of chunks, their mean length in words, and how many have each term: one row a task is sent."""
    ship(chunks.sparkSession)
    size = len(asked.places)
    shared = chunks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, df = 0, 0, np.zeros(size, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                for text in batch.column(0).slice(start, ROWS).to_pylist():
                    found = words(text)
                    n, length = n + 1, length + len(found)
                    at = np.array([p for p in map(shared.value.places.get, set(found)) if p is not None], dtype=np.int64)
                    df[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *range(size)], pa.int64()), pa.array([n, length, *df.tolist()], pa.int64())], ["at", "n"])

    rows = chunks.select(text_col).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    out = np.zeros(size + 2, dtype=np.int64)
    out[rows.column("at").to_numpy() + 2] = rows.column("n").to_numpy()
    return int(out[0]), out[1] / max(out[0], 1), out[2:]


def bm25_rows(chunks: DataFrame, queries: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """The k best chunks of each query in each task, with scores rounded to 4 digits."""
    asked = Asked.of(queries)
    n, mean, df = term_statistics(chunks, asked)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shared = chunks.sparkSession.sparkContext.broadcast((asked, idf, mean))

    def score(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        asked, idf, mean = shared.value
        c = Counted.of(texts.to_pylist(), asked)
        parts = c.tf * (k1 + 1) / (c.tf + k1 * (1 - b + b * c.lengths[c.row] / max(mean, 1e-300))) * idf[c.place]
        for at, own, member in asked.blocks:
            yield at, half_up(c.dense(own, parts) @ member, 4), c.dense(own, np.ones(len(c.row))) @ member > 0

    return scored_rows(chunks, "content", ["chunk_id", "document_id"], asked.ids, queries.schema["query_id"].dataType, k, score)


def all_terms_rows(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each task that hold all terms of a query, by how often they hold them per word."""
    asked = Asked.of(queries)
    shared = chunks.sparkSession.sparkContext.broadcast(asked)

    def score(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        c = Counted.of(texts.to_pylist(), shared.value)
        for at, own, member in shared.value.blocks:
            n = member.sum(0)
            yield at, half_up(c.dense(own, c.tf) @ member / np.maximum(c.lengths, 1)[:, None], 4), (c.dense(own, np.ones(len(c.row))) @ member == n) & (n > 0)

    return scored_rows(chunks, "content", ["chunk_id", "document_id"], asked.ids, queries.schema["query_id"].dataType, k, score)


def shared_terms_rows(evidence: DataFrame, claims: DataFrame, chosen: Callable[[bytes], bool]) -> DataFrame:
    """The best evidence of each task for each claim, by the share of the claim's terms that it has."""
    asked = Asked.of(claims, chosen=chosen)
    shared = evidence.sparkSession.sparkContext.broadcast(asked)

    def score(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        c = Counted.of(texts.to_pylist(), shared.value)
        for at, own, member in shared.value.blocks:
            both = c.dense(own, np.ones(len(c.row))) @ member
            yield at, both / np.maximum(member.sum(0), 1), both > 0

    return scored_rows(evidence, "content", ["evidence_id"], asked.ids, claims.schema["query_id"].dataType, 1, score)


def unit_rows(vectors: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length 1 (0 for those without length), and which of them are vectors of that many numbers."""
    flat = vectors.flatten()
    if not vectors.null_count and not flat.null_count and len(flat) == dim * len(vectors) and (pc.list_value_length(vectors).to_numpy(zero_copy_only=False) == dim).all():
        good, out = np.ones(len(vectors), dtype=bool), flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    else:
        told = vectors.to_pylist()
        good = np.array([v is not None and len(v) == dim and None not in v for v in told], dtype=bool)
        out = np.zeros((len(told), dim))
        if good.any():
            out[good] = np.array([v for v, g in zip(told, good, strict=True) if g], dtype=np.float64)
    norms = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norms > 0, norms, 1), good


def cosine_rows(vectors: DataFrame, queries: DataFrame, k: int, floor: float, certainty: bool, apart: str | None = None) -> DataFrame:
    """The k nearest vectors of each query in each task: score is the cosine, or (1 + cos) / 2, to 6 digits.

    ``apart`` names the column of the queries whose document is left out. Null
    vectors and those of another length than the first query's are left out.
    """
    table = queries.select("query_id", "vector", *([apart] if apart else [])).toArrow().combine_chunks()
    ids = table.column("query_id")
    ids = ids.chunk(0) if ids.num_chunks else pa.array([], ids.type)
    told = table.column("vector")
    told = told.chunk(0) if told.num_chunks else pa.array([], told.type)
    dim = next((len(v) for v in told if v.is_valid), 0)
    matrix, good = unit_rows(told, dim)
    own = np.array(table.column(apart).to_pylist(), dtype=object) if apart else None
    shared = vectors.sparkSession.sparkContext.broadcast((matrix, good, own))
    read = "_read"

    def score(rows: pa.StructArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        matrix, good, own = shared.value
        unit, whole = unit_rows(rows.field("embedding"), dim)
        documents = np.array(rows.field("document_id").to_pylist(), dtype=object)
        for at in range(0, len(matrix), QUERIES):
            cos = unit @ matrix[at : at + QUERIES].T
            met = whole[:, None] & good[None, at : at + QUERIES]
            if own is not None:
                other = documents[:, None] != own[None, at : at + QUERIES]
                met &= other & np.not_equal(documents, None)[:, None] & np.not_equal(own[at : at + QUERIES], None)[None]
            shown = half_up((1 + cos) / 2 if certainty else cos, 6)
            yield at, shown, met & ((cos if certainty else shown) >= floor)

    rows = vectors.select("chunk_id", "document_id", F.struct("embedding", "document_id").alias(read))
    return scored_rows(rows, read, ["chunk_id", "document_id"], ids, queries.schema["query_id"].dataType, k, score)
