"""Latent vectors against a dense singular value decomposition."""

import random

import numpy as np

from siftloom.operators import latent, search
from siftloom.sources import sinks


def texts(spark, n=300):
    r = random.Random(1)
    topics = [[f"{t}{i}" for i in range(25)] for t in "abcdef"]
    rows = [(i, f"d{i}", " ".join(r.choices(topics[i % 6], k=30) + r.choices(["common", "words"], k=5))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "none", None), (n + 1, "none", ""), (n + 2, "none", "only once")], "chunk_id long, document_id string, content string").repartition(3)


def dense(df, space):
    rows = [space.row(r.content) for r in df.collect()]
    out = np.zeros((len(rows), len(space.terms)))
    for i, (at, weights) in enumerate(rows):
        out[i, at] = weights
    return out


def test_singular_values_and_directions(spark):
    df = texts(spark)
    space = latent.fit(df, rank=8)
    a = dense(df, space)
    _, values, directions = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(space.singular[:6], values[:6], rtol=1e-4)
    assert np.allclose(space.basis.T @ space.basis, np.eye(8), atol=1e-8)
    # the plane of the topics is the same, whatever its axes
    assert np.allclose(np.linalg.norm(directions[:6] @ space.basis, axis=1), 1, atol=1e-3)
    assert b"once" not in space.terms and b"a1" in space.terms


def test_the_product_that_tasks_add_up(spark):
    df = texts(spark, 120)
    space = latent.vocabulary(df)
    a, q = dense(df, space), np.random.default_rng(1).normal(size=(len(space.terms), 5))
    assert np.allclose(latent.squared(latent.rows_of(df, space), q), a.T @ a @ q)


def test_texts_of_a_topic_are_near(spark):
    df = texts(spark)
    space = latent.fit(df, rank=6)
    vectors = latent.embedded(df, space)
    asked = vectors.where("chunk_id < 12").selectExpr("chunk_id as query_id", "embedding as vector")
    found = search.vectors_topk(vectors, asked, 20).collect()
    assert sum(r.chunk_id % 6 == r.query_id % 6 for r in found) / len(found) > 0.95
    # no word in common, but words that go together
    near = space.encode(["a1 a2 a3", "a9 a10 a11", "b1 b2 b3", "unknown", None])
    assert near[0] @ near[1] > 0.9 > 0.3 > abs(near[0] @ near[2])
    assert not near[3:].any()
    assert sinks.check_identity(None, space) == {"model_id": space.model_id, "dim": 6}


def test_nothing_to_learn(spark):
    df = texts(spark).where("chunk_id >= 300")
    space = latent.fit(df)
    assert space.dim == 0 and not space.terms


def test_sums_of_tasks_are_added_as_they_come():
    """Beside one batch, a task that adds up blocks holds one sum and one matrix, however many tasks sent it theirs."""
    import tracemalloc

    import pyarrow as pa

    def batch(block):
        data = [np.full(40_000, float(i)).tobytes() for i in range(200)]
        return pa.RecordBatch.from_arrays([pa.array([block] * 200, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    batches = [batch(0), batch(0), batch(3)]
    tracemalloc.start()
    found = {b.column("block")[0].as_py(): np.frombuffer(b.column("data")[0].as_py()) for b in latent.added(iter(batches))}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8_000_000
    assert (found[0] == 2 * sum(range(200))).all() and (found[3] == sum(range(200))).all() and len(found[0]) == 40_000


def test_a_large_batch_is_held_a_few_texts_at_a_time(spark, monkeypatch):
    """Of an Arrow batch of 24 MB a task that weighs or embeds texts has some hundred as Python objects."""
    import tracemalloc

    import pyarrow as pa

    class Rows:
        """Stands in for a table: gives what a task would run."""

        sparkSession, schema = spark, spark.range(0).selectExpr("'' as content").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(latent, "written", lambda run, _: run)
    space = latent.Space({b"a": 0, b"b": 1}, np.ones(2), np.eye(2))
    batch = pa.RecordBatch.from_arrays([pa.array([f"a b {i} " + "x" * 2000 for i in range(12_000)])], ["content"])
    for run in (latent.rows_of(Rows(), space), latent.embedded(Rows(), space)):
        tracemalloc.start()
        rows = sum(b.num_rows for b in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == 12_000 and most < 4_000_000
