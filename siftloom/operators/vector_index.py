"""A stored vector index: inverted lists over centroids with product-quantised codes, and exact scores for what they propose.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed.
The index is a folder of Parquet tables. ``lists`` has the vectors by segment
and list (the nearest centroid), each with a code: a byte for each part of what
the vector differs from its centroid by. A search reads the codes of the lists
nearest to its queries, keeps the best by code in the task that reads them, and
scores these by their vectors. An append is one more segment under the same
centroids.

``near_pairs`` is for sides that are both large: vectors and queries meet in
buckets of random projections by a shuffle, queries also in the buckets across
the planes that they lie nearest to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.operators.inrow import Best, half_up, unit_rows
from siftloom.session import ship

#: Vectors that centroids and codebooks are fitted on at most, the least hashes of their ids; the one bound of the fit.
SAMPLE = 20_000
#: Codes of a part of a vector.
CODES = 256
ROUNDS = 12
#: Rows and queries that are multiplied at a time.
ROWS, QUERIES = 2048, 64
#: Files that a list's rows are spread over, so that a list with very many rows is no single task.
SLICES = 8
#: Vectors of a bucket that are joined as one row, numbers of vectors that a task packs at a time and that leave it as one batch, and pairs that it holds before it keeps the best.
BLOCK, PACKED, SENT, PAIRS = 256, 1_280_000, 1_000_000, 200_000


@dataclass
class Model:
    """Unit centroids (lists, dim), codebooks (parts, codes, dim / parts), the dimension without padding."""

    centroids: np.ndarray
    books: np.ndarray
    dim: int

    def padded(self, unit: np.ndarray) -> np.ndarray:
        more = self.centroids.shape[1] - unit.shape[1]
        return np.pad(unit, ((0, 0), (0, more))) if more else unit

    def assigned(self, unit: np.ndarray) -> np.ndarray:
        return (self.padded(unit) @ self.centroids.T).argmax(1)

    def encoded(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """A byte for each part of each vector (rows, parts)."""
        rest = self.padded(unit) - self.centroids[lists]
        parts, _, size = self.books.shape
        out = np.empty((len(unit), parts), dtype=np.uint8)
        for p in range(parts):
            x, book = rest[:, p * size : (p + 1) * size], self.books[p]
            out[:, p] = ((book * book).sum(1)[None] - 2 * x @ book.T).argmin(1)
        return out

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """What each code of each part adds to a query's product: (queries, parts, codes)."""
        parts, _, size = self.books.shape
        x = self.padded(unit).reshape(len(unit), parts, size)
        return np.einsum("qps,pcs->qpc", x, self.books)


def means(points: np.ndarray, k: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    """k centroids of the points by Lloyd's rounds; fewer points than k repeat."""
    found = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(ROUNDS):
        nearest = (points @ found.T if spherical else 2 * points @ found.T - (found * found).sum(1)[None]).argmax(1)
        sums, n = np.zeros_like(found), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, points)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            found[empty] = points[rng.choice(len(points), len(empty))]
        if spherical:
            found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return found


def fit(vectors: DataFrame, lists: int = 64, parts: int = 16, seed: int = 7) -> Model:
    """A model from at most SAMPLE vectors (chunk_id, embedding), those with the least hashes of their ids. Raises ValueError without any vector."""
    some = vectors.where("embedding is not null and size(embedding) > 0").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").toArrow()
    rows = some.column("embedding").combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) and rows.num_chunks else rows
    if not len(rows):
        raise ValueError("no vector to fit an index on")
    dim = int(np.bincount([len(v) for v in rows]).argmax())
    unit, good = unit_rows(rows, dim)
    unit = unit[good & (np.abs(unit).sum(1) > 0)]
    if not len(unit):
        raise ValueError("no vector to fit an index on")
    parts = min(parts, dim)
    unit = np.pad(unit, ((0, 0), (0, -dim % parts)))
    rng = np.random.default_rng(seed)
    centroids = means(unit, lists, rng, True)
    rest = unit - centroids[(unit @ centroids.T).argmax(1)]
    size = unit.shape[1] // parts
    books = np.stack([means(rest[:, p * size : (p + 1) * size], CODES, rng, False) for p in range(parts)])
    return Model(centroids, books, dim)


def create(vectors: DataFrame, path: str, lists: int = 64, parts: int = 16) -> None:
    """An empty index at ``path`` with a model that is fitted on a sample of the vectors."""
    model = fit(vectors, lists, parts)
    flat = [("centroids", model.centroids), ("books", model.books), ("dim", np.array([model.dim]))]
    rows = [(name, list(x.shape), x.ravel().astype(float).tolist()) for name, x in flat]
    vectors.sparkSession.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").write.parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    """The model: lists + CODES rows of a vector's length, whatever the number of vectors."""
    told = {r.name: np.array(r.numbers).reshape(r.shape) for r in spark.read.parquet(f"{path}/model").collect()}
    return Model(told["centroids"], told["books"], int(told["dim"][0]))


def append(vectors: DataFrame, path: str, segment: str) -> None:
    """Add vectors (chunk_id, document_id, embedding) as a segment; writing a segment again replaces it.

    Null vectors and those of another length than the model's are left out, as
    exact search leaves them out.
    """
    spark = vectors.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load(spark, path))
    rows = vectors.select("chunk_id", "document_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            unit, good = unit_rows(batch.column("embedding"), model.dim)
            lists = model.assigned(unit)
            codes = model.encoded(unit, lists)
            columns = [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lists.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "code", "list"]).filter(pa.array(good))

    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("list", T.IntegerType())])
    placed = rows.mapInArrow(run, schema).withColumn("segment", F.lit(segment))
    dealt = placed.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(SLICES))).sortWithinPartitions("list", "chunk_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", "list").parquet(f"{path}/lists")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8, again: int = 10) -> DataFrame:
    """The k nearest vectors of each query by cosine: query_id, chunk_id, document_id, score ((1 + cos) / 2), pos.

    queries: query_id, vector, of a size that one machine holds (large sides take
    ``near_pairs``). Each query reads the codes of the ``probes`` lists whose
    centroids are nearest; ``again`` * k of them, the best by code, are scored by
    their vectors. Null vectors and those of another length find nothing. Ties
    go to the smaller id.
    """
    ship(spark)
    model = load(spark, path)
    table = queries.select("query_id", "vector").toArrow().combine_chunks()
    ids, told = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in (table.column("query_id"), table.column("vector")))
    unit, good = unit_rows(told, model.dim)
    order = np.argsort(-(model.padded(unit) @ model.centroids.T), axis=1, kind="stable")[:, :probes]
    wanted: dict[int, list[int]] = {}
    for q in np.flatnonzero(good).tolist():
        for c in order[q].tolist():
            wanted.setdefault(c, []).append(q)
    stored = spark.read.parquet(f"{path}/lists").where(F.col("list").isin(sorted(wanted)))
    shared = spark.sparkContext.broadcast((model, unit, {c: np.array(qs) for c, qs in wanted.items()}))
    n_queries, kept = len(ids), again * k
    codes = stored.select("chunk_id", "list", "code")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, unit, wanted = shared.value
        parts = np.arange(model.books.shape[0])
        best: Best | None = None
        for batch in batches:
            lists = batch.column("list").to_numpy()
            for c in np.unique(lists).tolist():
                some = pa.Table.from_batches([batch.filter(pa.array(lists == c))])
                for at in range(0, some.num_rows, ROWS):
                    part = some.slice(at, ROWS).combine_chunks()
                    own = part.select(["chunk_id", "list"])
                    best = best or Best(n_queries, kept, own.schema)
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                    for q in np.array_split(wanted[c], -(-len(wanted[c]) // QUERIES)):
                        base = model.padded(unit[q]) @ model.centroids[c]
                        near = model.tables(unit[q])[:, parts[None], code].sum(2).T + base[None]
                        for i, query in enumerate(q.tolist()):
                            best.add(query, near[:, i : i + 1], np.ones((len(near), 1), dtype=bool), own)
        if best is not None:
            yield from best.result(ids)

    id_field, key = T.StructField("query_id", queries.schema["query_id"].dataType), stored.schema["chunk_id"]
    proposed = codes.mapInArrow(propose, T.StructType([id_field, key, T.StructField("list", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    proposed = proposed.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= kept).select("query_id", "chunk_id", "list")
    # again * k rows for each of the queries, whose vectors one machine holds
    exact = stored.select("chunk_id", "document_id", "list", "embedding").join(F.broadcast(proposed), ["list", "chunk_id"]).join(F.broadcast(queries.select("query_id", "vector")), "query_id")
    return ranked(exact.select("query_id", "chunk_id", "document_id", "embedding", "vector"), k, -1.0, True)


def ranked(pairs: DataFrame, k: int, floor: float, certainty: bool) -> DataFrame:
    """The k best of each query among pairs (query_id, chunk_id, document_id, embedding, vector), by exact cosine."""
    from siftloom.operators.search import cosine

    scored = pairs.select("query_id", "chunk_id", "document_id", cosine(F.col("embedding"), F.col("vector")).alias("cos"))
    score = F.round((1 + F.col("cos")) / 2 if certainty else F.col("cos"), 6)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    kept = scored.select("query_id", "chunk_id", "document_id", score.alias("score"), "cos").where(F.col("cos" if certainty else "score") >= floor).drop("cos")
    return kept.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def packed_blocks(parts: list[pa.RecordBatch], planes: np.ndarray, tables: int, flips: int) -> Iterator[pa.RecordBatch]:
    """Blocks of each bucket of some rows (id, document, vector), in batches of about SENT numbers: a vector is in many blocks."""
    dim, bits = len(planes), planes.shape[1] // tables
    table = pa.Table.from_batches(parts).combine_chunks()
    unit, good = unit_rows(table.column("vector").chunk(0), dim)
    at = np.flatnonzero(good)
    if not len(at):
        return
    numbers = np.array(table.column("vector").chunk(0).take(pa.array(at)).flatten(), dtype=np.float32).reshape(len(at), dim)
    told = [table.column(c).chunk(0).take(pa.array(at)) for c in ("id", "document")]
    for t in range(tables):
        side = unit[at] @ planes[:, t * bits : (t + 1) * bits]
        own = (side > 0) @ (1 << np.arange(bits))
        near = np.argsort(np.abs(side), axis=1)[:, :flips]
        buckets = (t << bits) + np.concatenate([own[:, None], own[:, None] ^ (1 << near)], axis=1)
        flat, row = buckets.ravel(), np.repeat(np.arange(len(at)), buckets.shape[1])
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        nth = np.arange(len(flat)) - np.searchsorted(flat, flat)
        starts = np.flatnonzero(nth % BLOCK == 0)
        edges = np.append(starts, len(flat))
        first = 0
        while first < len(starts):
            last = max(int(np.searchsorted(edges, edges[first] + SENT // dim, side="right")) - 1, first + 1)
            some, rows_ = edges[first : last + 1], row[edges[first] : edges[last]]
            lists = [pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), x.take(pa.array(rows_))) for x in told]
            data = [numbers[row[a:b]].tobytes() for a, b in zip(some[:-1].tolist(), some[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[starts[first:last]]), *lists, pa.array(data, pa.binary())], ["bucket", "ids", "documents", "data"])
            first = last


def _packed(rows: DataFrame, planes: np.ndarray, tables: int, flips: int) -> DataFrame:
    """Rows (id, document, vector) as blocks of a bucket: bucket, ids, documents, data (their numbers).

    A vector is in a bucket of each table, by the sides of that table's planes
    that it lies on; with ``flips`` also in those across its nearest planes.
    """
    ship(rows.sparkSession)
    dim = len(planes)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "document")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        most, n = max(PACKED // max(dim, 1), BLOCK), 0
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                held.append(batch.slice(start, most))
                n += held[-1].num_rows
                if n >= most:
                    yield from packed_blocks(held, planes, tables, flips)
                    held, n = [], 0
        if held:
            yield from packed_blocks(held, planes, tables, flips)

    return rows.mapInArrow(run, f"bucket long, ids array<{kinds['id']}>, documents array<{kinds['document']}>, data binary")


def near_pairs(vectors: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.92, tables: int = 8, flips: int = 6, bits: int | None = None, seed: int = 11) -> DataFrame:
    """For each query its k nearest vectors of other documents with at least ``floor``: query_id, chunk_id, document_id, cos, pos.

    vectors: chunk_id, document_id, embedding; queries: query_id, query_document,
    vector. Both sides are packed into blocks of a bucket and joined by a shuffle
    on it; rows of the join are pairs of blocks, so that a bucket with very many
    vectors can be split, and a task keeps k rows a query. Scores are exact; what
    a query has in common with no bucket is not found: of pairs with a cosine of
    0.9 or more that is few (see the tests), of pairs far below 0.8 most. Rows
    without a vector or document, and vectors of another length than the first
    query's, are left out. ``bits`` planes a table: as many as give a bucket about
    64 vectors, if it is not told.
    """
    first = queries.where("vector is not null").select(F.size("vector").alias("n")).first()
    dim = first.n if first else 1
    n = vectors.count() if bits is None else 0
    bits = bits or int(np.clip(np.ceil(np.log2(max(n, 1) / 64)), 2, 24))
    planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))
    whole = "id is not null and document is not null and vector is not null"
    theirs = _packed(vectors.select(F.col("chunk_id").alias("id"), F.col("document_id").alias("document"), F.col("embedding").alias("vector")).where(whole), planes, tables, 0)
    own = _packed(queries.select(F.col("query_id").alias("id"), F.col("query_document").alias("document"), "vector").where(whole), planes, tables, min(flips, bits))
    both = own.select("bucket", F.col("ids").alias("q_ids"), F.col("documents").alias("q_documents"), F.col("data").alias("q_data")).join(theirs, "bucket").drop("bucket")

    def unit(data: bytes) -> np.ndarray:
        x = np.frombuffer(data, dtype=np.float32).reshape(-1, dim).astype(np.float64)
        norms = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norms > 0, norms, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def best() -> pa.Table:
            table = pa.concat_tables(held).group_by(["query_id", "chunk_id"]).aggregate([("document_id", "min"), ("cos", "max")])
            table = table.select(["query_id", "chunk_id", "document_id_min", "cos_max"]).rename_columns(["query_id", "chunk_id", "document_id", "cos"])
            table = table.sort_by([("query_id", "ascending"), ("cos", "descending"), ("chunk_id", "ascending")]).combine_chunks()
            query = table.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
            return table.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))

        for batch in batches:
            lists = {c: batch.column(c) for c in ("q_ids", "q_documents", "ids", "documents")}
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            n = sum(t.num_rows for t in held)
            for i in range(batch.num_rows):
                a, b = (unit(batch.column(c)[i].as_py()) for c in ("q_data", "data"))
                cos = half_up(a @ b.T, 6)
                mine, other = (lists[c][i].values for c in ("q_documents", "documents"))
                if mine.type == other.type:
                    both = pa.concat_arrays([mine, other]).dictionary_encode().indices.to_numpy()
                    mine, other = both[: len(mine)], both[len(mine) :]
                else:
                    mine, other = (np.array(x.to_pylist(), dtype=object) for x in (mine, other))
                cos = np.where((mine[:, None] != other[None]) & (cos >= floor), cos, -np.inf)
                if cos.shape[1] > k:
                    cos = np.where(cos >= np.partition(cos, -k, axis=1)[:, -k][:, None], cos, -np.inf)
                q, v = np.nonzero(cos > -np.inf)
                if len(q):
                    found.append((q + lists["q_ids"].offsets[i].as_py(), v + lists["ids"].offsets[i].as_py(), cos[q, v]))
                    n += len(q)
                if found and (n >= PAIRS or i == batch.num_rows - 1):
                    q, v, near = (np.concatenate(x) for x in zip(*found, strict=True))
                    held.append(pa.table([lists["q_ids"].values.take(pa.array(q)), lists["ids"].values.take(pa.array(v)), lists["documents"].values.take(pa.array(v)), pa.array(near)], ["query_id", "chunk_id", "document_id", "cos"]))
                    found = []
                if n >= PAIRS:
                    held = [best()]
                    n = held[0].num_rows
                    if n >= PAIRS // 2:  # the best of many queries: what follows ranks them with those of other tasks anyway
                        yield from held[0].to_batches()
                        held, n = [], 0
        if held:
            yield from best().to_batches()

    kinds = [queries.schema["query_id"], vectors.schema["chunk_id"], vectors.schema["document_id"]]
    met = both.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in kinds), T.StructField("cos", T.DoubleType())]))
    met = met.groupBy("query_id", "chunk_id").agg(F.min("document_id").alias("document_id"), F.max("cos").alias("cos"))
    order = Window.partitionBy("query_id").orderBy(F.col("cos").desc(), "chunk_id")
    return met.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
