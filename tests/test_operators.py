import pytest
from pyspark.sql import functions as F

from siftloom.operators import evaluation, search, tables
from siftloom.sources import sinks
from siftloom.streaming import conversations, limits


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", x, i) for i, x in enumerate("aabcd", 1)] + [("none", "z", 1)], "query_id string, id string, rank int")
    judged = spark.createDataFrame([("q", "b", 2), ("q", "d", 1), ("q", "x", 0), ("none", "y", 1), ("empty", "y", 0)], "query_id string, id string, grade int")
    got = {r.query_id: r for r in evaluation.metrics(ranked, judged, 2).collect()}
    assert (got["q"].recall, got["q"].mrr, got["q"].hit) == (0.5, 0.5, 1.0)
    assert got["q"].ndcg == pytest.approx((3 / 1.5849625) / (3 + 1 / 1.5849625), abs=1e-5)
    assert got["none"].recall == got["none"].mrr == got["empty"].ndcg == 0
    assert {r.recall for r in evaluation.metrics(ranked, judged, 0).collect()} == {0.0}


def test_replay(spark):
    results = spark.createDataFrame([("kw", 1, "a", 1), ("kw", 1, "b", 2), ("vec", 1, "b", 1)], "mode string, query_id int, id string, rank int")
    cases = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "query_id int, id string, grade int")
    assert rows(evaluation.replay_metrics(cases, results, 5), "mode", "recall", "hit") == [("kw", 0.5, 0.5), ("vec", 0.0, 0.0)]


def test_diversify(spark):
    r = spark.createDataFrame([(1, f"a{i}", "A", 1.0, i) for i in range(1, 11)] + [(1, "b", "B", 0.5, 11), (1, "c", "C", 0.4, 12)], "query_id int, chunk_id string, document_id string, score double, pos int")
    assert [x.chunk_id for x in search.diversified(r, 3).orderBy("pos").collect()] == ["a1", "b", "c"]
    assert [x.chunk_id for x in search.diversified(r, 12).orderBy("pos").collect()][:3] == ["a1", "a2", "a3"]


def test_scope_and_filters(spark):
    df = spark.createDataFrame([("w", ["a=1", "b=2"]), ("v", ["a=1"])], "workspace_id string, tags array<string>")
    assert search.in_scope(df, "w").count() == 1
    with pytest.raises(ValueError):
        search.in_scope(df, " ")
    assert df.where(search.tag_filter("tags", {"a": ["1", "9"], "b": ["2"]}, ["a", "b"])).count() == 1
    with pytest.raises(ValueError):
        search.tag_filter("tags", {"c": ["1"]}, ["a"])
    assert search.fetch_size(10, True, True) == 50 and search.fetch_size(60, True, False) == 100 and search.fetch_size(5, False, False) == 5


def test_tables(spark):
    claims = spark.createDataFrame([("d", 1, 10), ("d", 2, 20)], "document_id string, run_id int, claimed_at int")
    writes = spark.createDataFrame([("d", 1), ("d", 2), ("e", 9)], "document_id string, run_id int")
    assert rows(tables.fenced(claims, writes), "document_id", "run_id") == [("d", 2), ("e", 9)]
    chunks = spark.createDataFrame([(1, 0, "a", 1, "h"), (1, 1, "b", 1, "h")], "doc_id int, chunk_index int, content string, token_count long, content_hash string").withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))
    edits = spark.createDataFrame([(1, 0, "new text", "other"), (1, 1, "new text", None)], "doc_id int, chunk_index int, content string, expected_hash string")
    assert rows(tables.edited_chunks(chunks, edits, F.lit("2024-02-01").cast("timestamp")), "chunk_index", "content") == [(0, "a"), (1, "new text")]
    more = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "doc_id int, nth int, content string")
    assert rows(tables.next_indices(chunks, more), "doc_id", "chunk_index", "content") == [(1, 2, "x"), (1, 3, "y"), (2, 0, "z")]
    spaces = spark.createDataFrame([("a", "u", []), ("b", "o", [("u", "member")]), ("c", "o", [("u", "odd")])], "id string, owner_id string, members array<struct<user_id:string,role:string>>")
    assert rows(tables.accessible(spaces, "u"), "id") == [("a",), ("b",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("w", "u", "d", 0, "one two"), ("w", "u", "d", 1, " "), ("v", "u", "e", 0, None)], "workspace_id string, user_id string, document_id string, chunk_index int, content string")
    encoder = sinks.HashingEncoder(16)
    vectors = sinks.vector_rows(df, encoder).collect()
    assert [sum(x * x for x in r.embedding) == pytest.approx(n, abs=1e-5) for r, n in zip(vectors, (1, 0, 0), strict=True)] == [True] * 3
    path = str(tmp_path / "t")
    sinks.write_partitions(df, path)
    sinks.write_partitions(df.where("workspace_id = 'w' AND chunk_index = 0"), path)
    assert rows(spark.read.parquet(path), "workspace_id", "chunk_index") == [("v", 0), ("w", 0)]
    assert sinks.check_identity(None, encoder) == sinks.check_identity({"model_id": "hashing-16", "dim": 16}, encoder)
    with pytest.raises(ValueError):
        sinks.check_identity({"model_id": "x", "dim": 3}, encoder)


def test_buffer():
    b = conversations.Buffer()
    assert b.add("1", "x" * 3999, 5) and not b.add("1", "again", 50) and not b.full() and b.deadline == 5 + conversations.WAIT_MS
    b.add("2", "yy", 60)
    assert b.full() and b.deadline == 5 + conversations.WAIT_MS
    assert b.flush("size")["turn_ids"] == ["1", "2"] and b.flush("size") is None and not b.add("2", "", 1)
    for i in range(conversations.SEEN):
        b.add(f"n{i}", "", 9)
    assert b.add("1", "evicted", 9)


def test_stream(spark, tmp_path):
    source, store, letters = (str(tmp_path / x) for x in ("in", "store", "letters"))
    data = [(1, "a", "see postgres://u:pa55word@h/db now"), (1, "a", "repeat"), (1, "lost", None), (1, "b", "z" * 4000), (2, "c", "short")]
    spark.createDataFrame(data, "conv_id long, turn_id string, text string").coalesce(1).write.json(source)
    turns = limits.file_queue(spark, source, "conv_id long, turn_id string, text string")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep the query awake
    q = conversations.batches(turns).writeStream.foreachBatch(conversations.flush_writer(store, letters)).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    got = [r for r in rows(spark.read.parquet(store), "conv_id", "chunk_index", "content") if r[0] == 1]  # a slow machine may time the other one out
    again = spark.createDataFrame([(1, 9, ["x"], ["later"])], "conv_id long, batch long, turn_ids array<string>, texts array<string>")
    conversations.flush_writer(store, letters)(again, 1_000)
    assert rows(spark.read.parquet(store).where("batch = 1000"), "conv_id", "chunk_index", "content") == [(1, 2, "later")]
    assert got[0] == (1, 0, "see [redacted:connection_string] now") and len(got) == 2 and got[1][2].startswith("z")
    assert rows(spark.read.parquet(letters), "conv_id", "at", "dedup_key") == [(1, 1, "lost")]
    assert rows(spark.read.parquet(f"{store}_statistics").where("conv_id = 1 AND kept > 1"), "kept", "dropped", "masked") == [(2, 1, 1)]


def test_token_bucket(spark):
    times = [0, 1, 2, 3, 40, 41]
    e = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "event_id int, k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = [r.allowed for r in limits.token_bucket(e, "k", "ts", 2, 60).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, False]


def test_first_hit_windows(spark):
    """A window lasts from its first hit whatever comes in; hits every 30 s with a window of 60 s open a new one every second time."""
    e = spark.createDataFrame([(i, k, 30 * i) for k in (1, 2) for i in range(6)] + [(9, None, 1)], "event_id int, k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = limits.first_hit_windows(e, "k", "ts", 1, 60).where("k = 1").orderBy("event_id").collect()
    assert [(r.window_start.minute, r.nth, r.allowed) for r in got] == [(0, 1, True), (0, 2, False), (1, 1, True), (1, 2, False), (2, 1, True), (2, 2, False)]


def test_walk_takes_batches(spark):
    """One key over many Arrow batches: the state goes on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    e = spark.range(500).selectExpr("id AS event_id", "1 AS k", "timestamp_seconds(id) AS ts")
    assert limits.token_bucket(e, "k", "ts", 10, 100).where("allowed").count() == 10 + 49
    turns = spark.range(40).selectExpr("id % 2 AS conv_id", "id AS nth", "string(id) AS turn_id", "repeat('x', 900) AS text")
    got = conversations.batches_offline(turns).collect()
    assert [len(r.texts) for r in sorted(got, key=lambda r: (r.conv_id, r.batch))] == [5, 5, 5, 5] * 2
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_redelivery(spark, tmp_path):
    pending = spark.createDataFrame([("a", 1, 9000), ("b", 5, 9000), ("c", None, 9000), ("d", 7, 10), ("e", 2, None)], "message_id string, deliveries int, idle_ms long")
    again, poison, waiting = limits.reclaimed(pending, 1000, 5)
    assert rows(again, "message_id", "deliveries") == [("a", 2), ("c", 1)] and rows(poison, "message_id") == [("b",)] and rows(waiting, "message_id") == [("d",), ("e",)]
    letters = str(tmp_path / "letters")
    limits.consumer(lambda m: m.where("message_id <> 'c'"), letters, 5)(pending, 3)
    assert rows(spark.read.parquet(letters), "message_id", "reason") == [("b", "poison"), ("c", "failed"), ("d", "poison")]


def test_entry_without_optional_parts():
    import __spark_entry__

    assert "bm25_topk" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_reuse(spark):
    from siftloom.operators import reuse

    text = "a passage that is long enough to count as one of its kind"
    stored = spark.createDataFrame([(1, 10, text + "!", [1.0, 0.0]), (2, 20, text, [1.0, 0.01]), (3, 30, "q" * 60, [1.0, 0.0]), (4, 40, text, [0.0, 1.0])], "chunk_id int, document_id int, content string, embedding array<float>")
    new = spark.createDataFrame([(9, 20, text, [1.0, 0.0]), (8, 20, "short", [1.0, 0.0])], "chunk_id int, document_id int, content string, embedding array<float>")
    got = reuse.reuse_events(new, stored)
    assert rows(got, "new_chunk", "chunk_id") == [(9, 1)] and rows(reuse.reuse_counts(got), "chunk_id", "reuse_count") == [(1, 1)]
    ledger = got.select("new_document", "content_hash", "document_id", "chunk_id")
    assert reuse.reuse_events(new, stored, ledger).count() == 0
    # another passage of the same document that repeats the same chunk is an event of its own
    second = spark.createDataFrame([(7, 20, text + "!", [1.0, 0.0])], new.schema)
    assert rows(reuse.reuse_events(new.unionByName(second), stored, ledger), "new_chunk", "chunk_id") == [(7, 1)]


def test_promotion_needs_chunks_of_the_event(spark):
    from siftloom.operators import evaluation

    events = spark.createDataFrame([(i, ["d1", "d2", "d1"], ["c1", "c2", "c3"]) for i in range(7)] + [(7, [], [])], "event_id int, document_ids array<string>, chunk_ids array<string>")
    said = [(0, "answered", None), (1, "answered", ["c3", "c1"]), (2, "answered", ["other"]), (3, "partial", ["c2"]), (4, "partial", []), (5, "not_relevant", ["c1"]), (6, "partial", ["x"]), (7, "answered", None), (9, "answered", None)]
    got = evaluation.promoted(events, spark.createDataFrame(said, "event_id int, verdict string, evidence array<string>"))
    assert sorted(map(tuple, got.collect())) == [(0, 2, ["d1", "d2"]), (1, 2, ["d1"]), (3, 1, ["d2"])]


def test_gate_counts_what_is_absent_as_nothing(spark):
    from siftloom.operators import evaluation

    base = spark.createDataFrame([("kw", "mrr", 0.9), ("kw", "recall", 0.015), ("vec", "mrr", 0.01)], "mode string, metric string, value double")
    now = spark.createDataFrame([("kw", "mrr", 0.89, 100), ("new", "mrr", 0.5, 100)], "mode string, metric string, value double, n int")
    got = {(r.mode, r.metric): (r.delta, r.regressed) for r in evaluation.gate(base, now).collect()}
    assert got == {("kw", "mrr"): (-0.01, False), ("kw", "recall"): (-0.015, False), ("vec", "mrr"): (-0.01, False)}
    assert all(r.regressed for r in evaluation.gate(base.where("metric = 'mrr' and mode = 'kw'"), now.limit(0)).collect())
    assert {(r.mode, r.metric): r.value for r in evaluation.ratcheted(base, now).collect()} == {("kw", "mrr"): 0.9, ("kw", "recall"): 0.015, ("vec", "mrr"): 0.01, ("new", "mrr"): 0.5}


def test_scorecard_in_full(spark):
    import datetime as dt

    from siftloom.operators import evaluation

    now, old = dt.datetime(2024, 3, 1), dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([("w", v, t) for v, t in [("sufficient", now), ("sufficient", now), (None, now), ("low_confidence", now), ("sufficient", old)]] + [("v", None, old)], "workspace_id string, quality_verdict string, created_at timestamp")
    feedback = spark.createDataFrame([("w", i, v, q, t) for i, v, q, t in [(1, "answered", "a", now), (2, "partial", "b", now), (3, "not_relevant", "c", now), (4, "not_relevant", "d", old)]], "workspace_id string, event_id int, verdict string, query_text string, created_at timestamp")
    cases = spark.createDataFrame([("w", True)] * 3 + [("w", False), ("u", True)], "workspace_id string, active boolean")
    runs = spark.createDataFrame([("w", 1, "completed", old), ("w", 2, "failed", now)], "workspace_id string, run_id int, status string, started_at timestamp")
    got = {r.workspace_id: r for r in evaluation.full_scorecard(events, feedback, cases, runs, F.lit(now), least=3).collect()}
    w = got["w"]
    assert (w.captured, w.feedback, w.feedback_rate, w.answer_rate, w.eval_case_count, w.low_confidence) == (4, 3, 0.75, 0.666667, 3, False)
    assert w.verdict_distribution == {"sufficient": 2, "low_confidence": 1} and w.feedback_distribution == {"answered": 1, "partial": 1, "not_relevant": 1}
    assert w.gaps == ["c", "d"] and (w.last_run.run_id, w.last_run.status) == (2, "failed")
    assert w.summary == "4 searches captured in 30 days. 3 of them have feedback (75%); 67% of that is answered in full or in part. 3 labelled cases. Queries without relevant results: c, d."
    assert (got["u"].captured, got["u"].answer_rate, got["u"].low_confidence, got["u"].last_run) == (0, None, True, None)
    assert "v" not in got


def test_clean(spark):
    from siftloom.functions.sanitise import clean, cleaned

    assert clean(" e\u0301\u200b\x07\n b ", 4) == "\u00e9\n b" and clean("a \n b", one_line=True) == "a b"
    df = spark.createDataFrame([("a\x00 ",), (None,)], "t string")
    assert [r.t for r in df.select(cleaned(F.col("t")).alias("t")).collect()] == ["a", None]


def test_joins_and_rows_agree(spark, monkeypatch):
    """Queries that are too large to be broadcast give the same by joins; small blocks of queries and terms too."""
    from siftloom.operators import inrow

    texts = ["the cat sat", "a cat and a dog", "", None, "dog dog dog the", "Émile the cat", "x " * 50 + "cat", "the cat sat", "nothing here"]
    chunks = spark.createDataFrame([(i, f"d{i % 3}", t) for i, t in enumerate(texts)], "chunk_id int, document_id string, content string").repartition(3)
    queries = spark.createDataFrame([("q1", "cat the"), ("q2", "dog"), ("q3", ""), ("q4", None), ("q5", "absent"), ("q6", "CAT cat sat")], "query_id string, query string")
    vectors = spark.createDataFrame([(i, f"d{i % 3}", v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0], None, [-1.0, 0.5]])], "chunk_id int, document_id string, embedding array<float>").repartition(2)
    asked = spark.createDataFrame([(1, "d0", [1.0, 0.2]), (2, "d1", [0.0, 0.0]), (3, "d2", None)], "query_id int, query_document string, vector array<float>")
    claims = queries.select(F.col("query_id").alias("claim_id"), F.col("query").alias("content"))
    evidence = chunks.select(F.col("chunk_id").alias("evidence_id"), "content")

    def every():
        return [
            rows(search.bm25(chunks, queries, 3), "query_id", "chunk_id", "document_id", "score", "pos"), rows(search.all_terms(chunks, queries, 3), "query_id", "chunk_id", "score", "pos"),
            rows(search.vectors_topk(vectors, asked, 4, -0.5), "query_id", "chunk_id", "score", "pos"), rows(search.nearest_others(vectors, asked, 2, -0.9), "query_id", "chunk_id", "cos", "pos"),
            sorted(tuple(map(str, r)) for r in search.claims_supported(claims, evidence).collect()),
        ]

    got = every()
    assert all(got) and ("q1", 0) in [r[:2] for r in got[0]] and [r[1] for r in got[1] if r[0] == "q6"] == [0, 7]
    monkeypatch.setattr(inrow, "MAX_BYTES", -1)
    assert every() == got
    monkeypatch.undo()
    monkeypatch.setattr(inrow, "QUERIES", 2)
    assert every() == got
    none = chunks.where("false")
    assert search.bm25(none, queries, 3).count() == search.all_terms(none, queries, 3).count() == 0 and search.bm25(chunks, queries.where("false"), 3).count() == 0


def test_best_rows_keep_ties_in_order():
    """More rows than are held at once: the same best as by sorting all, ties by id."""
    import numpy as np
    import pyarrow as pa

    from siftloom.operators import inrow

    rng = np.random.default_rng(2)
    best = inrow.Best(3, 4, pa.schema([("chunk_id", pa.int64())]))
    every = []
    for at in range(0, 5000, 100):
        ids = rng.permutation(np.arange(at, at + 100))
        scores = rng.integers(0, 5, (100, 3)) / 4
        best.add(0, scores, scores > 0, pa.table({"chunk_id": ids}))
        every += [(q, -scores[i, q], ids[i]) for i in range(100) for q in range(3) if scores[i, q] > 0]
        best._prune()
    got = pa.Table.from_batches(best.result(pa.array([10, 11, 12])))
    want = [x for q in range(3) for x in sorted(y for y in every if y[0] == q)[:4]]
    assert list(zip(got["query_id"].to_pylist(), got["chunk_id"].to_pylist(), strict=True)) == [(10 + q, i) for q, _, i in want]


def test_isolation(spark):
    page = spark.createDataFrame([(1, 5, "d", 0.5, 1)], "query_id int, chunk_id int, document_id string, score double, pos int")

    def broken():
        raise RuntimeError("no index")

    merged, failures = search.isolated({"a": lambda: page, "b": broken, "c": lambda: page.withColumn("chunk_id", F.lit(4)), "d": lambda: page.withColumn("score", F.raise_error(F.lit("late")).cast("double"))}, 5)
    assert rows(merged, "chunk_id", "pos") == [(4, 1), (5, 2)] and set(failures) == {"b", "d"} and "no index" in failures["b"]
    with pytest.raises(RuntimeError):
        search.isolated({"b": broken}, 5, (RuntimeError,))
    assert search.tool_search({"a": lambda: search.in_scope(page, " ")}, 5) == (None, "a workspace must be named")
    assert search.isolated({"b": broken}, 5)[0] is None


def test_pack(spark):
    from siftloom.operators import tagging

    told = '{"name": "law", "chunking": {"strategy": "numbered_sections", "heading_patterns": [{"level": 1, "regex": "(\\\\d+) [A-Z]"}], "split_at_level": 1, "max_tokens": 50}, "tag_schema": {"fields": {"kind": {"type": "enum", "values": ["lease", "other"], "rules": {"lease": ["rent"]}}, "on": {"type": "date"}}}}'
    pack = tagging.read_pack(told)
    assert pack.name == "law" and pack.sections.split_at == 1 and pack.sections.max_tokens == 50
    df = spark.createDataFrame([("h", "the Rent is due", {"on": "2024-01-02"}), (None, None, None)], "heading string, content string, metadata map<string,string>")
    assert [r.tag_strings for r in tagging.tagged(df, pack.tagger).collect()] == [["kind=lease", "on=2024-01-02"], ["kind=other"]]
    for bad in ("[]", "{}", "{"):
        with pytest.raises(ValueError):
            tagging.read_pack(bad)
    with pytest.raises(ValueError):
        tagging.RulesTagger({"x": tagging.TagField("number")}).tags(F.lit(""), F.lit(""), F.lit(None))


def test_only_absent_parts_are_passed_over(tmp_path):
    """The entry module hides that the subpackage is not there, and nothing else."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "siftloom", tmp_path / "siftloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('N', len(e.queries()), 'op9_bpe' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert run().stdout.startswith("N ") and run().stdout.split()[2] == "False"
    (tmp_path / "siftloom" / "llm").mkdir()
    (tmp_path / "siftloom" / "llm" / "__init__.py").touch()
    (tmp_path / "siftloom" / "llm" / "queries.py").write_text("import no_such_library\n")
    assert "no_such_library" in run().stderr and not run().stdout


def test_percentiles_are_exact(spark):
    """Against sorting: ties, outliers, one value, none, a null group and more rows than the sketch tells apart."""
    import numpy as np

    from siftloom.operators import stats

    rng = np.random.default_rng(4)
    groups = {"wide": rng.lognormal(0, 4, 30_000), "ties": rng.integers(0, 3, 25_000) * 1.0, "few": np.array([1.0, 2.0]), "one": np.array([7.0]), None: rng.standard_normal(500), "out": np.r_[np.zeros(20_000), 1e9]}
    data = [(k, float(x)) for k, v in groups.items() for x in v] + [("none", None), ("few", None)]
    got = {r.k: r for r in stats.percentiles(spark.createDataFrame(data, "k string, v double").repartition(5), "k", "v", (0.0, 0.5, 0.95, 0.99, 1.0)).collect()}
    assert set(got) == {*groups, "none"} and got["none"].n == 0 and got["none"].p50 is None
    for k, v in groups.items():
        assert got[k].n == len(v)
        assert [got[k][f"p{p}"] for p in (0, 50, 95, 99, 100)] == pytest.approx(np.percentile(v, [0, 50, 95, 99, 100]), rel=1e-9, abs=1e-6)


def test_stored_lookups_read_one_bucket(spark, tmp_path):
    from siftloom.operators import stored

    chunks = spark.createDataFrame([("w1" if i % 3 else "w2", f"d{i % 40}", i, "x") for i in range(400)] + [("w1", "hot", i, "y") for i in range(200)] + [(None, "d1", 0, "z")], "workspace_id string, document_id string, chunk_index int, content string")
    for _ in range(2):  # a repeated write changes nothing
        stored.put(chunks, str(tmp_path), order=["chunk_index"], buckets=8)
    found = stored.of_document(spark, str(tmp_path), "w1", "d7")
    want = chunks.where("workspace_id = 'w1' and document_id = 'd7'")
    assert rows(found, *chunks.columns) == rows(want, *chunks.columns) and found.count() > 0
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(workspace_id" in plan and "EqualTo(document_id,d7)" in plan
    assert stored.of_document(spark, str(tmp_path), "w2", "hot").count() == 0 and stored.of_document(spark, str(tmp_path), "w1", None).count() == 0
    ids = spark.createDataFrame([("d7",), ("d7",), ("hot",), (None,)], "document_id string")
    assert stored.of_documents(spark, str(tmp_path), "w1", ids).count() == want.count() + 200
    with pytest.raises(ValueError, match="workspace"):
        stored.of_document(spark, str(tmp_path), " ", "d7")


def test_first_and_repeated_append(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    for _ in range(2):
        sinks.append_new(new, str(tmp_path / "t"), ["id"])
    sinks.append_new(spark.createDataFrame([(2, "other"), (3, "d")], new.schema), str(tmp_path / "t"), ["id"])
    assert [r.id for r in spark.read.parquet(str(tmp_path / "t")).orderBy("id").collect()] == [1, 2, 3]


def test_evaluation_events_as_rows(spark):
    import datetime as dt

    from siftloom.operators import lifecycle

    day = lambda n: dt.datetime(2024, 1, n)
    events = spark.createDataFrame([(1, "w", day(1)), (2, "w", day(5)), (3, "v", day(6))], "event_id int, workspace_id string, created_at timestamp")
    more = spark.createDataFrame([(2, "w", day(9)), (4, "w", day(8)), (4, "w", day(8))], events.schema)
    every = lifecycle.events_inserted(events, more)
    assert rows(every, "event_id", "created_at") == [(1, day(1)), (2, day(5)), (3, day(6)), (4, day(8))]
    assert [r.event_id for r in lifecycle.events_of(every, ["w"], limit=2).collect()] == [4, 2]
    assert lifecycle.events_of(every, ["w"], 3).count() == 0 and lifecycle.events_of(every, ["v"], 3).count() == 1
    assert rows(lifecycle.events_kept(every, F.lit(day(9)), 4), "event_id") == [(3,), (4,)]
    with pytest.raises(ValueError, match="workspaces"):
        lifecycle.events_of(every, [])


def test_stems_find_inflected_forms(spark):
    from siftloom.operators import fulltext

    texts = [
        (1, "The gardeners were watering plants, and the garden grew.", "en"), (2, "She waters a plant in the garden of the house", "en"), (3, "water only", "en"), (4, "Die Wohnungen sind teuer", "de"), (5, "eine teure Wohnung", "de"),
        (6, "las canciones cantadas", "es"), (7, "Les chanteuses chantent", "fr"), (8, None, "en"), (9, "", None), (10, "watering plants", None), (11, "plant " + "x " * 40 + "watered", "en"),
    ]
    chunks = spark.createDataFrame([(i, f"d{i}", t, lang) for i, t, lang in texts], "chunk_id int, document_id string, content string, lang string")
    asked = spark.createDataFrame([("a", "watered plants"), ("b", "eine Wohnung"), ("c", "the of"), ("d", None), ("e", "chanteuse"), ("f", "watering")], "query_id string, query string")
    got = {}
    for r in fulltext.stemmed_topk(chunks, asked, 10).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert got["a"] == [(1, 1.0), (2, 0.6667), (11, 0.0476)]
    assert [i for i, _ in got["b"]] == [4, 5]
    assert [i for i, _ in got["e"]] == [7] and {i for i, _ in got["f"]} == {1, 2, 3, 10, 11}
    assert not {"c", "d"} & got.keys()


def test_best_rows_are_held_in_few_tables():
    """Each step may add a better row to a query: what is held is put together again and again."""
    import numpy as np
    import pyarrow as pa

    from siftloom.operators import inrow

    best = inrow.Best(1, 10, pa.schema([("chunk_id", pa.int64())]))
    for i in range(3000):
        best.add(0, np.array([[float(i)]]), np.ones((1, 1), dtype=bool), pa.table({"chunk_id": pa.array([i])}))
        assert sum(t.column("score").num_chunks for t in best.held) <= inrow.HELD + 1
    assert [r["chunk_id"] for b in best.result(pa.array(["q"])) for r in b.to_pylist()] == list(range(2999, 2989, -1))


def test_tasks_where_keys_meet_grow_in_number_with_the_rows(spark, monkeypatch):
    """Line items are dealt by key over tasks of so many rows, and chunks and their edits meet there without another shuffle."""
    from siftloom import session
    from siftloom.plans import lifecycle
    from siftloom.plans.registry import Tables

    monkeypatch.setattr(session, "DEALT", 500)
    t = Tables(spark, "/root/testdata/sf0.001")
    tasks = -(-t.lineitem.count() // 500)
    assert tasks > spark.sparkContext.defaultParallelism
    assert lifecycle._lines(t).rdd.getNumPartitions() == tasks
    plan = lifecycle.edited_chunks(t)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert f", {tasks}), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
