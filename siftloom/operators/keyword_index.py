"""A stored inverted index for BM25: searches read the postings of the asked terms, not the corpus.

The index is a folder of Parquet tables. ``postings`` has a row for each block
of up to BLOCK chunks that hold a term: how often, and how long these chunks
are, with the greatest count and the least length of the block, which bound what
any chunk of the block can score for the term. Blocks are partitioned by segment
and by a hash of the term, and sorted by term, so that a search prunes
partitions and row groups. ``part`` names the chunks that were turned into blocks
together: all blocks of a chunk have the same. ``chunks`` has each chunk's document and length,
``totals`` the sums of a segment. An append is one more segment; nothing that is
there is read or rewritten, and BM25's statistics are sums over segments.

A search finds a least score first: the k-th best of what the rarest terms of a
query give alone. A block is read further only if its bound, with the bounds of
the query's other terms, reaches that score; a chunk that is among the k best
has all its blocks read, so results are those of a scan. Blocks are shuffled
whole, by part; a task adds up the scores of a part's chunks and keeps k a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.operators.inrow import ROWS, Asked, Best, Counted, fits, half_up, words
from siftloom.operators.search import B, BROADCAST_BYTES, K1, terms, top
from siftloom.session import ship

#: Chunks of a block at most.
BLOCK = 128
#: Words that a task turns into blocks at a time, which are a part.
HELD = 1_000_000
#: Words whose blocks a task sorts and writes, and postings that a task of a search scores, about.
WRITTEN, SCORED = 2_000_000, 1_000_000
#: Terms that a scan is told one by one; beyond that only partitions are pruned.
TOLD = 2_000
#: Terms of a query, the rarest ones, that give the least score.
SEEDS = 3

_BLOCK = "term string, n int, max_tf int, min_len int, ids array<{}>, tfs array<int>, lengths array<int>, part long"


def _blocks(chunks: DataFrame) -> DataFrame:
    """term, n, max_tf, min_len, ids, tfs, lengths, part of each block, made in the task that reads the chunks."""
    ship(chunks.sparkSession)
    id_type = chunks.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, list[list[bytes]]]] = []
        n, part = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                found = [words(t) for t in some.column("content").to_pylist()]
                held.append((some.column("chunk_id"), found))
                n += sum(map(len, found))
                if n >= HELD:
                    yield from block_batches(held, part)
                    held, n, part = [], 0, part + 1
        yield from block_batches(held, part)

    return chunks.select("chunk_id", "content").mapInArrow(run, _BLOCK.format(id_type))


def block_batches(held: list[tuple[pa.Array, list[list[bytes]]]], part: int) -> Iterator[pa.RecordBatch]:
    """Blocks of some texts' words, sorted by term, ids ascending within a term."""
    texts = [t for _, some in held for t in some]
    lengths = np.array([len(t) for t in texts], dtype=np.int32)
    if not lengths.sum():
        return
    ids = pa.concat_arrays([i for i, _ in held])
    by_id = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable") if not ids.null_count else np.arange(len(ids))
    places: dict[bytes, int] = {}
    code = np.fromiter((places.setdefault(w, len(places)) for i in by_id.tolist() for w in texts[i]), dtype=np.int64, count=int(lengths.sum()))
    vocabulary = sorted(places)
    order = np.empty(len(vocabulary), dtype=np.int64)
    order[[places[w] for w in vocabulary]] = np.arange(len(vocabulary))
    text = np.repeat(np.arange(len(texts)), lengths[by_id])
    pairs, tf = np.unique(order[code] * len(texts) + text, return_counts=True)
    term, text = np.divmod(pairs, len(texts))
    nth = np.arange(len(term)) - np.searchsorted(term, term)
    starts = np.flatnonzero(nth % BLOCK == 0)
    offsets = pa.array(np.append(starts, len(term)).astype(np.int32))
    own = lengths[by_id][text]

    def lists(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(offsets, values)

    spelled = pa.array(vocabulary, pa.binary()).cast(pa.string())
    columns = [
        spelled.take(pa.array(term[starts])),
        pa.array(np.diff(np.append(starts, len(term))).astype(np.int32)),
        pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)),
        pa.array(np.minimum.reduceat(own, starts).astype(np.int32)),
        lists(ids.take(pa.array(by_id[text]))),
        lists(pa.array(tf.astype(np.int32))),
        lists(pa.array(own.astype(np.int32))),
        pa.array(np.full(len(starts), part)),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["term", "n", "max_tf", "min_len", "ids", "tfs", "lengths", "part"])


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def append(chunks: DataFrame, path: str, segment: str, buckets: int = 64) -> None:
    """Add chunks (chunk_id, document_id, content) as a segment; writing a segment again replaces it, so a repeated append changes nothing.

    A chunk must be in one segment only. Null contents count as chunks without
    words. ``buckets`` is fixed when the index is made: a search of t terms reads
    at most t of them, so large corpora take thousands.
    """
    rows = chunks.select("chunk_id", "document_id", "content")

    def put(table: DataFrame, name: str, *by: str) -> None:
        writer = table.withColumn("segment", F.lit(segment)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        # delta encoding of ids and terms is the newer page format's own
        writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").partitionBy("segment", *by).parquet(f"{path}/{name}")

    counted = rows.select("chunk_id", "document_id", F.size(terms("content")).alias("length"))
    put(counted, "chunks")
    own = rows.sparkSession.read.parquet(f"{path}/chunks").where(F.col("segment") == segment)
    totals = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
    # a bucket takes as many tasks as its words need; full blocks are those of frequent terms: they alone are spread, so a rare term's blocks lie together
    slices = -(-max(totals.first().length, 1) // (WRITTEN * buckets))
    blocks = _blocks(rows).withColumn("bucket", bucket_of(F.col("term"), buckets))
    nth = F.pmod(F.when(F.col("n") == BLOCK, F.xxhash64("ids")).otherwise(F.xxhash64("term", F.lit(1))), F.lit(slices)).cast("int")
    put(blocks.repartitionById(buckets * slices, F.col("bucket") * slices + nth).sortWithinPartitions("bucket", "term"), "postings", "bucket")
    put(totals, "totals")
    put(rows.sparkSession.range(1).select(F.lit(buckets).alias("buckets")), "layout")


def postings_of(spark: SparkSession, path: str, asked: DataFrame, bounded: bool) -> DataFrame:
    """The blocks of the asked terms.

    Terms of a batch that is ``bounded`` (by its bytes) are told to the scan: their
    buckets always, the terms themselves up to TOLD of them, ten at a time, as
    Parquet filters take them. Others meet the blocks by a join.
    """
    buckets = spark.read.parquet(f"{path}/layout").agg(F.max("buckets")).first()[0]
    id_type = spark.read.parquet(f"{path}/chunks").schema["chunk_id"].dataType.simpleString()
    blocks = spark.read.schema(f"{_BLOCK.format(id_type)}, segment string, bucket int").parquet(f"{path}/postings")
    distinct = asked.select("term").distinct()
    if not bounded:
        return blocks.join(distinct, "term", "left_semi")
    told = [r.term for r in distinct.orderBy("term").collect()]
    numbers = [r.bucket for r in distinct.select(bucket_of(F.col("term"), buckets).alias("bucket")).distinct().collect()]
    blocks = blocks.where(F.col("bucket").isin(numbers))
    if len(told) <= TOLD:
        parts = [F.col("term").isin(told[i : i + 10]) for i in range(0, len(told), 10)]
        return blocks.where(reduce(lambda a, b: a | b, parts, F.lit(False)))
    return blocks.join(F.broadcast(distinct), "term", "left_semi")  # within the bytes of the batch


def _score(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def weights(spark: SparkSession, path: str, blocks: DataFrame) -> tuple[DataFrame, float]:
    """For each asked term that is there term, df, idf and ``most``, the most that a chunk can score for it; and the mean length of all chunks."""
    n, length = spark.read.parquet(f"{path}/totals").agg(F.sum("n"), F.sum("length")).first()
    mean = max((length or 0) / max(n or 0, 1), 1e-300)
    bound = F.max(_score(F.col("max_tf"), F.col("min_len"), mean))
    found = blocks.groupBy("term").agg(F.sum("n").alias("df"), bound.alias("bound"))
    idf = F.log1p((F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return found.select("term", "df", idf.alias("idf"), (idf * F.col("bound")).alias("most")), mean


def _scored(blocks: DataFrame, mean: float) -> DataFrame:
    """query_id, chunk_id, score: the sums over blocks that are joined with the queries' terms (query_id, idf)."""
    each = blocks.select("query_id", "idf", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("x"))
    part = F.col("idf") * _score(F.col("x.tfs"), F.col("x.lengths"), mean)
    return each.groupBy("query_id", F.col("x.ids").alias("chunk_id")).agg(F.sum(part).alias("score"))


def needed(blocks: DataFrame, wanted: DataFrame, least: DataFrame, mean: float) -> DataFrame:
    """The asked blocks that can hold one of the k best of a query, a row for each such query.

    wanted: query_id, term, idf, most; least: query_id, least (a score that k
    chunks of the query reach; queries without one need all).
    """
    others = F.sum("most").over(Window.partitionBy("query_id")) - F.col("most")
    asked = wanted.withColumn("others", others).join(least, "query_id", "left").select("query_id", "term", "idf", "others", "least")
    bound = F.col("idf") * _score(F.col("max_tf"), F.col("min_len"), mean) + F.col("others")
    # scores are rounded to four digits, and sums of doubles may differ in their last ones
    return blocks.join(asked, "term").where(F.col("least").isNull() | (bound >= F.col("least") - 1.01e-4))


def _best(blocks: DataFrame, asked: Asked, idf: np.ndarray, id_type: T.DataType, postings: int, mean: float, k: int, digits: int | None) -> DataFrame:
    """The k best chunks of each query in each task: query_id, chunk_id, score. Blocks of a part meet in one task, whole.

    asked: queries with terms that are there; idf: of each of them by its place.
    """
    ship(blocks.sparkSession)
    shared = blocks.sparkSession.sparkContext.broadcast((asked, idf, pa.array(list(asked.places), pa.binary()).cast(pa.string())))
    key = blocks.schema["ids"].dataType.elementType

    def scores(parts: list[pa.RecordBatch], best: Best | None) -> Best:
        asked, idf, spelled = shared.value
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, tfs, lengths = (pc.list_flatten(table.column(c)).combine_chunks() for c in ("ids", "tfs", "lengths"))
        place = pc.index_in(table.column("term"), spelled).to_numpy()
        place = np.repeat(place, pc.list_value_length(table.column("ids")).to_numpy())
        coded = ids.dictionary_encode()
        row = coded.indices.to_numpy()
        order = np.argsort(row, kind="stable")
        row, place, tf, length = row[order], place[order], tfs.to_numpy()[order].astype(np.float64), lengths.to_numpy()[order].astype(np.float64)
        value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) * idf[place]
        chunks = pa.table([coded.dictionary], schema=pa.schema([pa.field("chunk_id", coded.dictionary.type)]))
        best = best or Best(len(asked.ids), k, chunks.schema)
        for at in range(0, chunks.num_rows, ROWS):
            own = chunks.slice(at, ROWS)
            a, b = np.searchsorted(row, [at, at + own.num_rows])
            c = Counted(row[a:b] - at, place[a:b], tf[a:b], np.zeros(own.num_rows))
            for first, terms_, member in asked.blocks:
                found = c.dense(terms_, value[a:b]) @ member
                best.add(first, found if digits is None else half_up(found, digits), c.dense(terms_, np.ones(b - a)) @ member > 0, own)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, best = None, None
        for batch in batches:
            keys = list(zip(batch.column("segment").to_pylist(), batch.column("part").to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and keys[a] != now:
                    best = scores(held, best)
                    held = []
                now = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            best = scores(held, best)
        if best is not None:
            yield from best.result(shared.value[0].ids)

    tasks = max(-(-postings // SCORED), blocks.sparkSession.sparkContext.defaultParallelism)
    met = blocks.select("segment", "part", "term", "ids", "tfs", "lengths").repartition(tasks, "segment", "part").sortWithinPartitions("segment", "part")
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("chunk_id", key), T.StructField("score", T.DoubleType())])
    return met.mapInArrow(run, schema)


def _page(blocks: DataFrame, queries: DataFrame, weighed: DataFrame, mean: float, k: int) -> DataFrame:
    """The k best of each query of a batch whose terms the driver holds, from its blocks."""
    spark = blocks.sparkSession
    whole = Asked.of(queries)
    found = {r.term.encode(): r for r in weighed.collect()}  # a row for each term of the batch
    there = [t for t in whole.places if t in found]
    spelled = list(whole.places)
    df, idf, most = (np.array([float(found[t][c]) for t in there]) for c in ("df", "idf", "most"))
    places = {t: i for i, t in enumerate(there)}
    terms_ = [np.array([places[spelled[p]] for p in own.tolist() if spelled[p] in places], dtype=np.int64) for own in whole.terms]
    asked = Asked(whole.ids, places, terms_)
    id_type = queries.schema["query_id"].dataType
    by_term = sorted(range(len(there)), key=lambda p: (df[p], there[p]))
    rank = np.empty(len(there), dtype=np.int64)
    rank[by_term] = np.arange(len(there))
    rarest = [own[np.argsort(rank[own], kind="stable")[:SEEDS]] for own in terms_]
    seeds = np.unique(np.concatenate(rarest)) if rarest else np.empty(0, np.int64)

    def of(chosen: np.ndarray) -> DataFrame:
        rows = pa.table({"term": pa.array([there[p].decode() for p in chosen.tolist()], pa.string()), "idf": idf[chosen], "slack": slack[chosen]})
        return blocks.join(F.broadcast(spark.createDataFrame(rows)), "term")  # as many rows as the batch has terms

    slack = np.full(len(there), np.inf)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    seeded = _best(of(seeds), Asked(whole.ids, places, rarest), idf, id_type, int(df[seeds].sum()), mean, k, None)
    least = {r.query_id: r.score for r in seeded.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).collect()}  # at most one a query
    slack = np.full(len(there), -np.inf)
    for query, own in zip(whole.ids.to_pylist(), terms_, strict=True):
        slack[own] = np.maximum(slack[own], most[own].sum() - most[own] - least.get(query, -np.inf))
    # a block is read if it can matter to one of the queries; scores are rounded to four digits, and sums of doubles may differ in their last ones
    bound = F.col("idf") * _score(F.col("max_tf"), F.col("min_len"), mean)
    matter = of(np.arange(len(there))).where(bound + F.col("slack") >= -1.01e-4)
    return top(_best(matter, asked, idf, id_type, int(df.sum()), mean, k, 4), k)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """BM25 as :func:`search.bm25` gives it, from the index at ``path``: query_id, chunk_id, document_id, score, pos.

    Null and empty queries find nothing, nor do terms that no chunk has.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms("query"))).alias("term"))
    bounded = fits(queries, "query")
    blocks = postings_of(spark, path, asked, bounded)
    weighed, mean = weights(spark, path, blocks)
    if bounded:
        page = _page(blocks, queries, weighed, mean, k)
    else:
        wanted = asked.join(weighed, "term")
        rarest = Window.partitionBy("query_id").orderBy("df", "term")
        seeds = wanted.withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= SEEDS).select("query_id", "term", "idf")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        seeded = _scored(blocks.join(seeds, "term"), mean)
        least = seeded.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("query_id", F.col("score").alias("least"))
        page = top(_scored(needed(blocks, wanted, least, mean), mean), k)
    few = bounded and queries.count() * k * 64 <= BROADCAST_BYTES
    named = spark.read.parquet(f"{path}/chunks").select("chunk_id", "document_id").join(F.broadcast(page) if few else page, "chunk_id")
    return named.select("query_id", "chunk_id", "document_id", "score", "pos")
