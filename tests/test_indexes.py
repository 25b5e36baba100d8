"""Stored indexes against exact search."""

import random

import pytest
from pyspark.sql import functions as F

from siftloom.operators import keyword_index, search
from siftloom.session import shared_folder

VOCABULARY = [f"w{i}" for i in range(60)] + ["Été", "x", "9"]


def texts(n, seed, longest=60):
    r = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(VOCABULARY))]
    return [None if r.random() < 0.03 else " ".join(r.choices(VOCABULARY, weights, k=r.randint(0, longest))) + r.choice(["", ".", "!"]) for _ in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, f"d{i % 7}", t) for i, t in enumerate(texts(900, 1))], "chunk_id long, document_id string, content string").repartition(3).cache()


@pytest.fixture(scope="module")
def path(spark, chunks):
    found = shared_folder(spark, "test-index")
    keyword_index.append(chunks.where("chunk_id < 400"), found, "a", buckets=8)
    keyword_index.append(chunks.where("chunk_id >= 400"), found, "b", buckets=8)
    return found


def page(df):
    return sorted((r.query_id, r.pos, r.chunk_id, r.document_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_index_gives_what_a_scan_gives(spark, chunks, path, k):
    asked = [("q1", "w1 w2 w59"), ("q2", "w0"), ("q3", "W3, w3 w4 unknown"), ("q4", ""), ("q5", None), ("q6", "nothing there"), ("q7", " ".join(VOCABULARY))] + [(f"r{i}", t) for i, t in enumerate(texts(10, 2, 8))]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    assert page(keyword_index.search_index(spark, path, queries, k)) == page(search.bm25(chunks, queries, k))


def test_large_batches_meet_the_index_by_joins(spark, chunks, path, monkeypatch):
    queries = spark.createDataFrame([("q1", "w1 w2 w59"), ("q2", "w0")], "query_id string, query string")
    want = page(search.bm25(chunks, queries, 4))
    monkeypatch.setattr(keyword_index, "fits", lambda *_: False)
    assert page(keyword_index.search_index(spark, path, queries, 4)) == want
    monkeypatch.setattr(keyword_index, "fits", lambda *_: True)
    monkeypatch.setattr(keyword_index, "TOLD", 1)
    assert page(keyword_index.search_index(spark, path, queries, 4)) == want


def test_repeated_append_and_untouched_segments(spark, chunks, path):
    def files(segment):
        return sorted(f for f in spark.read.parquet(f"{path}/postings").where(F.col("segment") == segment).select("_metadata.file_path").distinct().toPandas()["file_path"])

    first = files("a")
    keyword_index.append(chunks.where("chunk_id >= 400"), path, "b", buckets=8)
    assert files("a") == first
    queries = spark.createDataFrame([("q1", "w1 w2 w59")], "query_id string, query string")
    assert page(keyword_index.search_index(spark, path, queries, 5)) == page(search.bm25(chunks, queries, 5))


def test_reads_follow_the_terms(spark, path):
    asked = spark.createDataFrame([("q", "w5")], "query_id string, term string")
    plan = keyword_index.postings_of(spark, path, asked, True)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan and "(term,w5)" in plan
    assert {r.term for r in keyword_index.postings_of(spark, path, asked, True).select("term").collect()} == {"w5"}


def test_blocks_that_cannot_matter_are_not_read(spark):
    """One text says the term often; blocks of texts that say it once need not be read for the best result."""
    rows = [(0, "d", "rare rare rare rare")] + [(i, "d", "rare " + "filler " * 40) for i in range(1, 2000)] + [(i, "d", "filler") for i in range(2000, 9000)]
    found = shared_folder(spark, "test-index")
    keyword_index.append(spark.createDataFrame(rows, "chunk_id long, document_id string, content string").coalesce(1), found, "a", buckets=2)
    asked = spark.createDataFrame([("q", "rare")], "query_id string, term string")
    blocks = keyword_index.postings_of(spark, found, asked, True)
    weighed, mean = keyword_index.weights(spark, found, blocks)
    wanted = asked.join(weighed, "term")
    least = spark.createDataFrame([("q", weighed.first().most)], "query_id string, least double")
    assert blocks.count() == 16
    assert keyword_index.needed(blocks, wanted, least, mean).count() == 1
    queries = spark.createDataFrame([("q", "rare")], "query_id string, query string")
    assert [r.chunk_id for r in keyword_index.search_index(spark, found, queries, 1).collect()] == [0]


def test_nothing_to_index(spark, chunks):
    found = shared_folder(spark, "test-index")
    keyword_index.append(spark.createDataFrame([(1, "d", None), (2, "d", " .")], chunks.schema), found, "a")
    queries = spark.createDataFrame([("q", "w1")], "query_id string, query string")
    assert keyword_index.search_index(spark, found, queries, 3).count() == 0


def clustered(n, dim, seed, spread=0.25):
    """Vectors around some centres, with copies, nulls and other lengths."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    found = centres[rng.integers(0, 30, n)] + spread * rng.normal(size=(n, dim))
    rows = [(i, int(i % 11), x.astype(np.float32).tolist()) for i, x in enumerate(found)]
    rows[5], rows[6], rows[7] = (5, 5, None), (6, 6, [1.0]), (7, 7, [0.0] * dim)
    return rows + [(n + i, 3, rows[9][2]) for i in range(40)]


def recall(got, want):
    g, w = ({(r.query_id, r.chunk_id) for r in x.collect()} for x in (got, want))
    return len(g & w) / max(len(w), 1)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(clustered(2500, 24, 5), "chunk_id long, document_id int, embedding array<float>").repartition(3).cache()


def test_vector_index_finds_what_exact_search_finds(spark, vectors):
    from siftloom.operators import vector_index

    found = shared_folder(spark, "test-vectors")
    vector_index.create(vectors, found, lists=20, parts=6)
    vector_index.append(vectors.where("chunk_id < 1000"), found, "a")
    vector_index.append(vectors.where("chunk_id >= 1000"), found, "b")
    vector_index.append(vectors.where("chunk_id >= 1000"), found, "b")
    asked = vectors.where("chunk_id % 50 = 0 or chunk_id in (5, 6)").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = search.vectors_topk(vectors, asked, 10)
    few = vector_index.search_index(spark, found, asked, 10, probes=4)
    assert recall(few, want) >= 0.9
    every = vector_index.search_index(spark, found, asked, 10, probes=20, again=500)
    own = lambda df: sorted(tuple(r) for r in df.where("query_id <> 6").select("query_id", "pos", "chunk_id", "document_id", "score").collect())
    assert own(every) == own(want)
    assert spark.read.parquet(f"{found}/lists").count() == vectors.where("size(embedding) = 24").count()
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "list#" in plan and " IN (" in plan or "INSET" in plan


def test_buckets_of_projections_find_near_vectors(spark, vectors):
    from siftloom.operators import vector_index

    asked = vectors.select(F.col("chunk_id").alias("query_id"), F.col("document_id").alias("query_document"), F.col("embedding").alias("vector"))
    for floor in (0.8, 0.92):
        want = search.nearest_others(vectors, asked, 5, floor)
        got = vector_index.near_pairs(vectors, asked, 5, floor)
        assert recall(got, want) >= 0.9
        plan = got._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # all vectors of a bucket: then nothing is missed
    every = vector_index.near_pairs(vectors, asked, 5, 0.8, tables=1, bits=1, flips=1)
    columns = ["query_id", "pos", "chunk_id", "document_id", "cos"]
    exact = search.nearest_others(vectors, asked, 5, 0.8)
    assert sorted(map(tuple, every.select(columns).collect())) == sorted(map(tuple, exact.select(columns).collect()))


def test_large_sides_take_the_buckets(spark, vectors, monkeypatch):
    from siftloom.operators import inrow

    asked = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("document_id").alias("query_document"), F.col("embedding").alias("vector"))
    want = search.nearest_others(vectors, asked, 5, 0.95)
    monkeypatch.setattr(inrow, "fits", lambda *_: False)
    assert recall(search.nearest_others(vectors, asked, 5, 0.95), want) >= 0.9


def test_no_vectors(spark, vectors):
    from siftloom.operators import vector_index

    asked = vectors.limit(0).select(F.col("chunk_id").alias("query_id"), F.col("document_id").alias("query_document"), F.col("embedding").alias("vector"))
    assert vector_index.near_pairs(vectors, asked).count() == 0
    with pytest.raises(ValueError, match="no vector"):
        vector_index.fit(vectors.where("embedding is null"))


def test_tasks_grow_in_number_with_the_words(spark, chunks, monkeypatch):
    """Blocks of a bucket are written, and blocks of a batch scored, by as many tasks as the words need; all blocks of a chunk are of one part."""
    monkeypatch.setattr(keyword_index, "WRITTEN", 500)
    monkeypatch.setattr(keyword_index, "SCORED", 50)
    found = shared_folder(spark, "test-index")
    keyword_index.append(chunks, found, "a", buckets=2)
    blocks = spark.read.parquet(f"{found}/postings")
    assert blocks.select("_metadata.file_path").distinct().count() > 10
    rare = blocks.groupBy("term").agg(F.max("n").alias("n"), F.count_distinct("_metadata.file_path").alias("files")).where(f"n < {keyword_index.BLOCK}")
    assert rare.count() and rare.where("files > 1").count() == 0
    assert blocks.select("part", F.explode("ids").alias("id")).groupBy("id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    queries = spark.createDataFrame([("q1", "w1 w2 w59"), ("q2", "w0"), ("q3", "w3 w4 unknown")], "query_id string, query string")
    assert page(keyword_index.search_index(spark, found, queries, 5)) == page(search.bm25(chunks, queries, 5))


def test_a_task_holds_a_part_at_a_time(spark):
    """A batch of Arrow may have many times HELD words."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("t"), ((i * 7 + F.col("id")) % 3000).cast("string"))), " ")
    long = spark.range(0, 2000, 1, 1).select(F.col("id").alias("chunk_id"), text.alias("content"))
    assert keyword_index._blocks(long).select("part").distinct().count() == 4


def test_packed_vectors_leave_a_few_at_a_time():
    """A vector is in a block of each bucket that it meets; a batch of such blocks stays small however many vectors a task packs."""
    import numpy as np
    import pyarrow as pa

    from siftloom.operators import vector_index

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(20_000, 64)).astype(np.float32)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), pa.array(np.arange(20_000) % 7), pa.array(list(vectors), pa.list_(pa.float32()))], ["id", "document", "vector"])
    met, n = np.zeros(20_000, dtype=np.int64), 0
    for batch in vector_index.packed_blocks([rows], rng.normal(size=(64, 8 * 9)), 8, 6):
        data, ids = batch.column("data").to_pylist(), batch.column("ids")
        assert sum(map(len, data)) <= 4 * vector_index.SENT
        assert max(map(len, ids.to_pylist())) <= vector_index.BLOCK and len(set(zip(batch.column("bucket").to_pylist(), data, strict=True))) == len(data)
        assert b"".join(data) == vectors[ids.flatten().to_numpy()].tobytes()
        np.add.at(met, ids.flatten().to_numpy(), 1)
        n += 1
    assert n > 50 and (met == 8 * 7).all()
