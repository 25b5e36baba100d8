"""Queries of retrieval and its evaluation; documents stand for chunks, benchmark passages for queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.operators import evaluation, fulltext, keyword_index, latent, reuse, search, vector_index
from siftloom.plans.registry import Tables, query
from siftloom.session import shared_folder, written

_BM25 = r"""
w AS (SELECT doc_id AS chunk_id, source AS document_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents),
a AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
whole AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
x AS (SELECT chunk_id, document_id, len(words) AS length, unnest(words) AS term FROM w),
p AS (SELECT chunk_id, document_id, length, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM a) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, chunk_id, document_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 4) AS score
      FROM p JOIN d USING (term) JOIN a USING (term), whole GROUP BY 1, 2, 3),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS pos FROM s QUALIFY pos <= 100)
"""


def _chunks(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("text").alias("content"))


def _queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _keyword(t: Tables, k: int = 100) -> DataFrame:
    return search.bm25(_chunks(t), _queries(t), k).select("query_id", "chunk_id", "document_id", "score", "pos")


@query(f"WITH {_BM25} SELECT query_id, chunk_id, document_id, score, pos FROM kw WHERE pos <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    return _keyword(t, 10)


@query(f"WITH {_BM25} SELECT query_id, chunk_id, document_id, score, pos FROM kw WHERE pos <= 10")
def bm25_index_topk(t: Tables) -> DataFrame:
    """The same from a stored index, made in one segment and an append."""
    path = shared_folder(t.spark, "keyword-index")
    chunks = _chunks(t)
    keyword_index.append(chunks.where("chunk_id % 3 > 0"), path, "first", buckets=8)
    keyword_index.append(chunks.where("chunk_id % 3 = 0"), path, "second", buckets=8)
    return keyword_index.search_index(t.spark, path, _queries(t), 10)


@query(r"""WITH w AS (SELECT doc_id AS chunk_id, source AS document_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents),
a AS (SELECT item_id AS query_id, list_slice(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), 1, 100000) AS t FROM benchmark),
q AS (SELECT query_id, len(t) AS n, unnest(t) AS term FROM a),
x AS (SELECT chunk_id, document_id, len(words) AS length, unnest(words) AS term FROM w),
p AS (SELECT chunk_id, document_id, length, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
s AS (SELECT query_id, chunk_id, document_id, round(sum(tf)::DOUBLE / any_value(length), 4) AS score FROM p JOIN q USING (term) GROUP BY 1, 2, 3 HAVING count(*) = any_value(n))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS pos FROM s QUALIFY pos <= 10""")
def full_text_topk(t: Tables) -> DataFrame:
    return search.all_terms(_chunks(t), _queries(t), 10)


@query(fulltext.sql(10))
def stemmed_topk(t: Tables) -> DataFrame:
    """Documents that hold the stems of a passage's first five words, by how near they lie."""
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("text").alias("content"), "lang")
    return fulltext.stemmed_topk(chunks, _queries(t).withColumn("query", F.substring_index("query", " ", 5)), 10)


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, a.label AS document_id, round((1 + {_DOT}) / 2, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS pos FROM s QUALIFY pos <= 10""")
def cosine_topk(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding")
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vectors_topk(vectors, asked, 10).select("query_id", "chunk_id", "document_id", "score", "pos")


@query()
def vector_index_topk(t: Tables) -> DataFrame:
    """Vectors with an id divisible by 100 against all, from a stored index of two segments. The vectors have no clusters, so most lists are read."""
    path = shared_folder(t.spark, "vector-index")
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding")
    vector_index.create(vectors, path, lists=16)
    vector_index.append(vectors.where("chunk_id % 3 > 0"), path, "first")
    vector_index.append(vectors.where("chunk_id % 3 = 0"), path, "second")
    asked = vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index.search_index(t.spark, path, asked, 10, probes=12)


@query(f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, a.label AS document_id, round({_DOT}, 6) AS cos FROM embeddings a, embeddings b WHERE a.label <> b.label + 1)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, chunk_id)::INT AS pos FROM s WHERE cos >= 0.8 QUALIFY pos <= 5""")
def near_vectors(t: Tables) -> DataFrame:
    """All vectors against all of other labels, by buckets of random projections: those with a cosine of 0.8 or more."""
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding")
    moved = t.embeddings.select(F.col("vec_id").alias("query_id"), (F.col("label") + 1).alias("query_document"), F.transform("embedding", lambda x: 2 * x).alias("vector"))
    return vector_index.near_pairs(vectors, moved, 5, 0.8)


@query(f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, a.label AS document_id, round({_DOT}, 6) AS cos FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 AND a.label <> b.label)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, chunk_id)::INT AS pos FROM s WHERE cos >= 0.1 QUALIFY pos <= 5""")
def knn_other_documents(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding")
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_document"), F.col("embedding").alias("vector"))
    return search.nearest_others(vectors, asked, 5, 0.1)


_HYBRID = f"""
v0 AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, round((1 + {_DOT}) / 2, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark)),
vc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM v0 QUALIFY pos <= 100),
ks AS (SELECT *, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1 END AS scaled FROM kw WINDOW q AS (PARTITION BY query_id)),
vs AS (SELECT *, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1 END AS scaled FROM vc WINDOW q AS (PARTITION BY query_id)),
h AS (SELECT query_id, chunk_id, round(0.7::DOUBLE * coalesce(vs.scaled, 0) + (1 - 0.7::DOUBLE) * coalesce(ks.scaled, 0), 4) AS score, ks.score AS bm25_score, vs.score AS vector_similarity FROM ks FULL JOIN vs USING (query_id, chunk_id))
"""


@query(f"WITH {_BM25}, {_HYBRID} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS pos FROM h QUALIFY pos <= 10")
def hybrid_topk(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.lit(None).cast("string").alias("document_id"), "embedding")
    asked = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.hybrid(_keyword(t), search.vectors_topk(vectors, asked, 100), 10).drop("document_id")


@query(f"""WITH {_BM25}, f AS (SELECT * FROM kw WHERE pos <= 50), m AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, document_id ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY query_id, document_id) AS first FROM f),
r AS (SELECT query_id, chunk_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 10 THEN pos ELSE turn END, CASE WHEN n <= 10 THEN 0 ELSE first END)::INT AS pos FROM m)
SELECT * FROM r WHERE pos <= 10""")
def diversified_topk(t: Tables) -> DataFrame:
    return search.diversified(_keyword(t, search.fetch_size(10, False, True)), 10).select("query_id", "chunk_id", "document_id", "score", "pos")


@query(f"""WITH {_BM25}, f AS (SELECT *, round(score * CASE WHEN chunk_id % 10 > 0 THEN least(1.5::DOUBLE, 1 + 0.1::DOUBLE * ln(1 + chunk_id % 10)) ELSE 1 END, 4) AS s2 FROM kw WHERE pos <= 20)
SELECT query_id, chunk_id, document_id, s2 AS score, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, pos)::INT AS pos FROM f""")
def reuse_boosted_topk(t: Tables) -> DataFrame:
    uses = t.documents.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 10).alias("reuse_count"))
    return search.boosted(_keyword(t, 20), uses, 0.1).select("query_id", "chunk_id", "document_id", "score", "pos")


def _latent(t: Tables, queries: DataFrame, k: int) -> DataFrame:
    """Texts near each query by latent semantic vectors that are learned from all documents."""
    space = latent.fit(_chunks(t))
    chunks = written(latent.embedded(_chunks(t), space), "latent")
    asked = latent.embedded(queries, space, "query").select("query_id", F.col("embedding").alias("vector"))
    return search.vectors_topk(chunks.select("chunk_id", "document_id", "embedding"), asked, k)


@query()
def latent_topk(t: Tables) -> DataFrame:
    """Benchmark passages against documents by vectors of their words."""
    return _latent(t, _queries(t), 10).select("query_id", "chunk_id", "document_id", "score", "pos")


@query()
def judged_modes(t: Tables) -> DataFrame:
    """Recall, MRR, nDCG and hit at 5 by keyword, latent vectors and both, of the first eight words of each passage that documents hold whole."""
    whole = t.documents.join(F.broadcast(_queries(t)), F.contains("text", "query"))  # stated passages against every text
    judged = written(whole.select("query_id", F.col("doc_id").alias("id"), F.lit(1).alias("grade")), "judged")
    asked = written(_queries(t).join(judged.select("query_id").distinct(), "query_id", "left_semi").withColumn("query", F.substring_index("query", " ", 8)), "asked")
    keyword = written(search.bm25(_chunks(t), asked, 50), "keyword")
    vector = written(_latent(t, asked, 50), "vector")
    legs = {"keyword": keyword, "vector": vector, "hybrid": search.hybrid(keyword, vector, 50)}
    rows = [leg.select(F.lit(mode).alias("mode"), "query_id", F.col("chunk_id").alias("id"), F.col("pos").alias("rank")) for mode, leg in legs.items()]
    return evaluation.replay_metrics(judged, rows[0].unionByName(rows[1]).unionByName(rows[2]), 5)


@query(f"""WITH {_BM25}, f AS (SELECT * FROM kw WHERE pos <= 5), g AS (SELECT query_id, count(*) AS n, max(score) AS top FROM f GROUP BY 1),
l AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY pos) AS chunk_ids, string_agg(document_id, ',' ORDER BY pos) AS document_ids FROM f GROUP BY 1)
SELECT item_id AS event_id, coalesce(document_ids, '') AS document_ids, coalesce(chunk_ids, '') AS chunk_ids, top AS top_score, CASE WHEN coalesce(n, 0) = 0 THEN 'insufficient_evidence' WHEN top < 0.5 THEN 'low_confidence' WHEN n < 2 THEN 'insufficient_evidence' ELSE 'sufficient' END AS quality_verdict
FROM benchmark LEFT JOIN g ON query_id = item_id LEFT JOIN l ON l.query_id = item_id""")
def captured_events(t: Tables) -> DataFrame:
    """What each search leaves for evaluation: its results side by side, the best score and the verdict."""
    found = _keyword(t, 5)
    asked = _queries(t).withColumn("event_id", F.col("query_id"))
    events = evaluation.captured(asked, found, search.verdicts(asked, found))
    return events.select("event_id", F.array_join("document_ids", ",").alias("document_ids"), F.array_join("chunk_ids", ",").alias("chunk_ids"), "top_score", "quality_verdict")


_SEMANTIC = f"""
v0 AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, a.label AS document_id, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark) AND a.label <> b.label),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM v0),
f AS (SELECT * FROM v WHERE pos <= 5 AND score >= 0.4), g AS (SELECT query_id, count(*) AS n, max(score) AS top FROM f GROUP BY 1)"""
_JUDGED = """CASE WHEN coalesce(n, 0) = 0 THEN 'insufficient_evidence' WHEN top < 0.5 THEN 'low_confidence' WHEN n < 2 THEN 'insufficient_evidence' ELSE 'sufficient' END AS verdict,
CASE WHEN coalesce(n, 0) = 0 THEN 'no_results' WHEN top < 0.5 THEN 'top_score_below_threshold' WHEN n < 2 THEN 'low_result_count' ELSE 'ok' END AS reason"""
_SHOWN = f"""{_SEMANTIC}, j AS (SELECT item_id AS query_id, {_JUDGED} FROM benchmark LEFT JOIN g ON query_id = item_id),
r AS (SELECT query_id, chunk_id, score, NULL::VARCHAR AS strategy FROM f JOIN j USING (query_id) WHERE verdict = 'sufficient'
UNION ALL SELECT query_id, chunk_id, score, 'keyword_retry' FROM kw JOIN j USING (query_id) WHERE verdict = 'low_confidence' AND pos <= 5
UNION ALL SELECT query_id, chunk_id, score, 'broadened_query' FROM v JOIN j USING (query_id) WHERE verdict = 'insufficient_evidence' AND pos <= 10)"""


def _semantic(t: Tables, limit: int, floor: float) -> DataFrame:
    """Vectors of other labels near each benchmark item's own, scored by cosine."""
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding")
    asked = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_document"), F.col("embedding").alias("vector"))
    return search.nearest_others(vectors, asked, limit, floor).withColumnRenamed("cos", "score")


def _legs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A semantic search for five results of at least 0.4, and both retries."""
    return _semantic(t, 5, 0.4), _keyword(t, 5), _semantic(t, search.broadened(5), -1.0)


@query(f"WITH {_SEMANTIC} SELECT item_id AS query_id, coalesce(n, 0) AS n_results, top AS top_score, greatest(0, least(1, coalesce(top, 0)))::DOUBLE AS confidence, {_JUDGED} FROM benchmark LEFT JOIN g ON query_id = item_id")
def quality_gate_verdict(t: Tables) -> DataFrame:
    return search.verdicts(_queries(t), _semantic(t, 5, 0.4))


@query(f"WITH {_BM25}, {_SHOWN} SELECT * FROM r")
def fallback_topk(t: Tables) -> DataFrame:
    return search.with_fallback(_queries(t), *_legs(t)).select("query_id", "chunk_id", "score", "strategy")


@query(f"""WITH {_BM25}, {_SHOWN}, last AS (SELECT query_id, count(*) AS n, max(score) AS top FROM r GROUP BY 1)
SELECT j.query_id, coalesce(n, 0) AS n_results, top AS top_score, greatest(0, least(1, coalesce(top, 0)))::DOUBLE AS confidence, {_JUDGED}, CASE j.verdict WHEN 'low_confidence' THEN 'keyword_retry' WHEN 'insufficient_evidence' THEN 'broadened_query' END AS strategy FROM j LEFT JOIN last ON last.query_id = j.query_id""")
def fallback_verdicts(t: Tables) -> DataFrame:
    return search.final_verdicts(_queries(t), *_legs(t))


@query("""WITH r AS (SELECT query_id, chunk_id, document_id, score FROM (SELECT custkey % 5 AS query_id, orderkey AS chunk_id, custkey AS document_id, price AS score FROM (SELECT o_orderkey AS orderkey, o_custkey AS custkey, round(o_totalprice / 1000, 1) AS price FROM orders)))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, document_id)::INT AS pos FROM r QUALIFY pos <= 20""")
def workspace_merge(t: Tables) -> DataFrame:
    found = t.orders.select((F.col("o_custkey") % 5).alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.round(F.col("o_totalprice") / 1000, 1).alias("score"))
    parts = [found.where(F.col("document_id") % 3 == i) for i in range(3)]
    return search.merged(parts, 20)


_TURNS = "c AS (SELECT conv_id AS document_id, turn AS chunk_index, text AS content FROM conversations), m AS (SELECT document_id, chunk_index FROM c WHERE length(content) > 700)"


def _matches(t: Tables) -> DataFrame:
    """Long turns; some are neighbours."""
    return _turns(t).where(F.length("content") > 700)


def _turns(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))


@query(f"""WITH {_TURNS}, s AS (SELECT DISTINCT document_id, greatest(chunk_index - 1, 0) AS lo, chunk_index + 1 AS hi FROM m),
o AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY document_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM s),
i AS (SELECT *, sum(opens) OVER (PARTITION BY document_id ORDER BY lo, hi) AS island FROM o)
SELECT document_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY document_id, island""")
def context_window_merge(t: Tables) -> DataFrame:
    return search.window_ranges(_matches(t), 1)


@query(f"""WITH {_TURNS} SELECT m.document_id, m.chunk_index,
array_to_string(list(c.content ORDER BY c.chunk_index) FILTER (c.chunk_index < m.chunk_index), '|') AS before, array_to_string(list(c.content ORDER BY c.chunk_index) FILTER (c.chunk_index > m.chunk_index), '|') AS after
FROM m LEFT JOIN c ON c.document_id = m.document_id AND c.chunk_index BETWEEN m.chunk_index - 2 AND m.chunk_index + 2 GROUP BY 1, 2""")
def context_window_assign(t: Tables) -> DataFrame:
    found = search.window_chunks(_matches(t), _turns(t), 2)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|")).alias(c)
    return found.select("document_id", "chunk_index", joined("before"), joined("after"))


@query(f"""WITH {_TURNS}, p AS (SELECT document_id, chunk_index, content, sum(length(content) + 2) OVER (PARTITION BY document_id ORDER BY chunk_index) - 2 AS to_char FROM c)
SELECT document_id, chunk_index, content, (to_char - length(content))::BIGINT AS from_char, to_char::BIGINT AS to_char FROM p WHERE to_char - length(content) < 1500 AND to_char > 500""")
def char_page_window(t: Tables) -> DataFrame:
    return search.character_page(_turns(t), 500, 1000)


_RANKED = """r AS (SELECT source AS query_id, doc_id // 2 AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
j0 AS (SELECT source AS query_id, doc_id // 2 AS id, quality + toxic AS grade FROM labels JOIN documents USING (doc_id)), j AS (SELECT query_id, id, max(grade) AS grade FROM j0 GROUP BY 1, 2),
d0 AS (SELECT query_id, id, min(rank) AS rank FROM r GROUP BY 1, 2), d AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS rank FROM d0),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS place FROM j WHERE grade > 0),
w AS (SELECT query_id, count(*) AS relevant, sum((2 ** grade - 1) / log2(place + 1)) FILTER (place <= 10) AS ideal FROM i GROUP BY 1),
f AS (SELECT d.query_id, count(*) FILTER (rank <= 10) AS hits, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM d JOIN j ON d.query_id = j.query_id AND d.id = j.id WHERE grade > 0 GROUP BY 1),
m AS (SELECT q.query_id, round(coalesce(hits::DOUBLE / relevant, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(CASE WHEN ideal > 0 THEN dcg / ideal END, 0), 6) AS ndcg, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit
 FROM (SELECT DISTINCT query_id FROM j) q LEFT JOIN w USING (query_id) LEFT JOIN f USING (query_id))"""


def _ranked(t: Tables) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    half = F.floor(F.col("doc_id") / 2).alias("id")
    ranked = t.documents.select(F.col("source").alias("query_id"), half, place.alias("rank"))
    judged = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(F.col("source").alias("query_id"), half, (F.col("quality") + F.col("toxic")).alias("grade"))
    return ranked, judged


@query(f"WITH {_RANKED} SELECT * FROM m")
def recall_mrr_ndcg(t: Tables) -> DataFrame:
    return evaluation.metrics(*_ranked(t), 10)


@query(f"""WITH {_RANKED}, u AS (UNPIVOT (SELECT query_id AS mode, recall, mrr, ndcg FROM m) ON recall, mrr, ndcg INTO NAME metric VALUE base),
c AS (SELECT mode, metric, round(base * CASE WHEN metric = 'mrr' THEN 0.4 ELSE 1.01 END, 6) AS value, 30 AS n FROM u WHERE mode <> 'src3')
SELECT u.mode, u.metric, u.base, c.value, round(coalesce(c.value, 0) - u.base, 6) AS delta,
round(greatest(0.02, CASE u.metric WHEN 'mrr' THEN 0.5 WHEN 'recall' THEN 1.0 ELSE 1 - 1 / log2(3) END / 30), 6) AS allowed,
coalesce(c.value, 0) < u.base - greatest(0.02, CASE u.metric WHEN 'mrr' THEN 0.5 WHEN 'recall' THEN 1.0 ELSE 1 - 1 / log2(3) END / 30) AS regressed, greatest(u.base, c.value) AS ratchet
FROM u LEFT JOIN c ON u.mode = c.mode AND u.metric = c.metric""")
def gate_regressions(t: Tables) -> DataFrame:
    rows = evaluation.metrics(*_ranked(t), 10).select(F.col("query_id").alias("mode"), "recall", "mrr", "ndcg").unpivot("mode", ["recall", "mrr", "ndcg"], "metric", "value")
    now = rows.where("mode <> 'src3'").select("mode", "metric", F.round(F.col("value") * F.when(F.col("metric") == "mrr", 0.4).otherwise(1.01), 6).alias("value"), F.lit(30).alias("n"))
    return evaluation.gate(rows, now)


@query(f"WITH {_RANKED} SELECT substr(query_id, 1, 4) AS mode, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit FROM m GROUP BY 1")
def eval_means(t: Tables) -> DataFrame:
    return evaluation.means(evaluation.metrics(*_ranked(t), 10).withColumn("mode", F.substring("query_id", 1, 4)))


@query("""WITH e AS (SELECT l_orderkey AS event_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS d, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS c FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey AS event_id, ['answered', 'partial', 'not_relevant'][1 + o_orderkey % 3] AS verdict, CASE WHEN o_orderkey % 2 = 0 THEN [1, 3] ELSE [] END AS evidence FROM orders),
g AS (SELECT e.event_id, CASE WHEN verdict = 'answered' THEN 2 WHEN verdict = 'partial' AND len(evidence) > 0 THEN 1 END AS grade, d, list_filter(d, lambda x, i: list_contains(evidence, c[i])) AS told, evidence FROM e JOIN f USING (event_id)),
x AS (SELECT event_id, grade, CASE WHEN len(evidence) > 0 THEN told ELSE d END AS expected FROM g WHERE grade IS NOT NULL)
SELECT event_id, grade, array_to_string(list_filter(expected, lambda v, i: list_position(expected, v) = i), ',') AS expected FROM x WHERE len(expected) > 0""")
def feedback_promotion(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    events = lines.select(F.col("l_orderkey").alias("event_id"), F.col("x.l_partkey").alias("document_ids"), F.col("x.l_linenumber").alias("chunk_ids"))
    verdict = F.element_at(F.array(*map(F.lit, ("answered", "partial", "not_relevant"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    evidence = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array().cast("array<int>"))
    feedback = t.orders.select(F.col("o_orderkey").alias("event_id"), verdict.alias("verdict"), evidence.alias("evidence"))
    return evaluation.promoted(events, feedback).withColumn("expected", F.array_join("expected", ","))


_VERDICT = "CASE event_type WHEN 'purchase' THEN 'answered' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'not_relevant' END"


@query(f"""WITH c AS (SELECT user_id % 20 AS workspace_id, count(*) AS captured FROM events GROUP BY 1),
v AS (SELECT user_id % 20 AS workspace_id, string_agg(kind || ':' || n, ',' ORDER BY kind) AS verdicts FROM (SELECT user_id, event_type AS kind, count(*) OVER (PARTITION BY user_id % 20, event_type) AS n, row_number() OVER (PARTITION BY user_id % 20, event_type) AS nth FROM events WHERE event_type <> 'view') WHERE nth = 1 GROUP BY 1),
x AS (SELECT user_id % 20 AS workspace_id, {_VERDICT} AS verdict FROM events WHERE event_type IN ('purchase', 'click', 'error') AND user_id % 20 <> 7),
f AS (SELECT workspace_id, count(*) AS feedback, count(*) FILTER (verdict IN ('answered', 'partial')) AS positive, concat('answered:', count(*) FILTER (verdict = 'answered'), ',not_relevant:', count(*) FILTER (verdict = 'not_relevant'), ',partial:', count(*) FILTER (verdict = 'partial')) AS feedbacks FROM x GROUP BY 1)
SELECT workspace_id, captured, coalesce(feedback, 0) AS feedback, round(coalesce(feedback, 0)::DOUBLE / captured, 6) AS feedback_rate,
CASE WHEN feedback > 0 THEN round(positive::DOUBLE / feedback, 6) END AS answer_rate, coalesce(verdicts, '') AS verdicts, coalesce(feedbacks, '') AS feedbacks FROM c LEFT JOIN f USING (workspace_id) LEFT JOIN v USING (workspace_id)""")
def eval_scorecard(t: Tables) -> DataFrame:
    rows = t.events.withColumn("workspace_id", F.col("user_id") % 20).withColumn("quality_verdict", F.expr("nullif(event_type, 'view')"))
    said = rows.where(F.col("event_type").isin("purchase", "click", "error") & (F.col("workspace_id") != 7)).withColumn("verdict", F.expr(_VERDICT))
    return evaluation.scorecard(rows, said).select("workspace_id", "captured", "feedback", "feedback_rate", "answer_rate", _told("verdict_distribution").alias("verdicts"), _told("feedback_distribution").alias("feedbacks"))


def _told(counts: str) -> Column:
    """A map of counts as one string, by name."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


@query("""SELECT o_orderstatus AS workspace_id, md5(lower(o_orderpriority)) AS case_key, min(o_orderpriority) AS query, array_to_string(list_sort(list_distinct(flatten(list([o_custkey % 7, o_custkey % 11])))), ',') AS expected, max(o_orderkey % 3) AS grade FROM orders GROUP BY 1, 2""")
def eval_case_merge(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderstatus").alias("workspace_id"), F.col("o_orderpriority").alias("query"), F.array(F.col("o_custkey") % 7, F.col("o_custkey") % 11).alias("expected"), (F.col("o_orderkey") % 3).alias("grade"))
    return evaluation.merged_cases(cases).withColumn("expected", F.array_join("expected", ","))


@query()
def reuse_detection(t: Tables) -> DataFrame:
    vectors = t.embeddings.withColumnRenamed("vec_id", "doc_id").join(t.documents.select("doc_id", "text"), "doc_id")
    chunks = vectors.select(F.col("doc_id").alias("chunk_id"), F.col("label").alias("document_id"), F.col("text").alias("content"), "embedding")
    return reuse.reuse_events(chunks.where("chunk_id % 100 = 0"), chunks, None, 0.1, 0.01)
