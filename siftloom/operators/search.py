"""Retrieval over batches of queries: keyword, vector and hybrid legs, and what follows them.

Results have the columns query_id, chunk_id, document_id, score and pos (from 1,
best first). All ranking breaks ties by id, so results do not depend on
partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.functions.text import BROADENED, INSUFFICIENT, KEYWORD_RETRY, LOW, STOPWORDS, claim_tokens, gate_reason, gate_verdict, reuse_multiplier, support_level
from siftloom.operators import inrow, scans, vector_index
from siftloom.session import written

#: Published defaults of BM25.
K1, B = 1.2, 0.75
ALPHA = 0.7
#: Bytes of a side that is broadcast at most; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Cosine from which on random projections find nearly all pairs.
NEAR = 0.8


def width(df: DataFrame) -> Column:
    """About how many bytes a row takes: 16 a column, and the lengths of texts and arrays."""
    found = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            found = found + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            found = found + 16 * F.greatest(F.size(field.name), F.lit(0))
    return found


def sized(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is within BROADCAST_BYTES; added up, since plans over explodes cannot tell."""
    return F.broadcast(df) if (df.agg(F.sum(width(df))).first()[0] or 0) <= BROADCAST_BYTES else df


def terms(text: str | Column) -> Column:
    """The lower-case ASCII words and numbers, in order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def in_scope(df: DataFrame, workspace: str, column: str = "workspace_id") -> DataFrame:
    """The rows of a workspace. Raises ValueError for a blank one rather than widening the search."""
    if not workspace or not workspace.strip():
        raise ValueError("a workspace must be named")
    return df.where(F.col(column) == workspace)


def tag_filter(tags: str, wanted: Mapping[str, Sequence[str]], known: Sequence[str]) -> Column:
    """Whether an array of ``field=value`` has one of the values of every field. Raises ValueError for unknown fields."""
    if unknown := sorted(set(wanted) - set(known)):
        raise ValueError(f"unknown fields: {unknown}")
    parts = [F.arrays_overlap(F.col(tags), F.array(*(F.lit(f"{k}={v}") for v in vs))) for k, vs in wanted.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def fetch_size(limit: int, filtered: bool, diversify: bool) -> int:
    """How many candidates to fetch for a page: more where filters or diversification drop some."""
    base = min(100, 3 * limit) if filtered else limit
    return max(base, min(100, 5 * limit)) if diversify else base


def top(scored: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """The k best of each query by rounded score, then id; a window group limit keeps k a task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    ranked = scored.withColumn("score", F.round("score", digits)).withColumn("pos", F.row_number().over(order))
    return ranked.where(F.col("pos") <= k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Keyword search: chunks (chunk_id, document_id, content), queries (query_id, query).

    Lengths and document frequencies are over all chunks. Chunks are scored in
    the task that reads them and k a query and task are shuffled; queries too
    large for that meet the postings of their terms by shuffle.
    """
    if inrow.fits(queries, "query"):
        return top(inrow.bm25_rows(chunks, queries, k, K1, B), k)
    asked = queries.select("query_id", F.explode(F.array_distinct(terms("query"))).alias("term"))
    words = chunks.select("chunk_id", "document_id", terms("content").alias("words")).withColumn("length", F.size("words"))
    whole = words.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    vocabulary = sized(asked.select("term").distinct())
    hits = words.select("chunk_id", "document_id", "length", F.explode("words").alias("term")).join(vocabulary, "term")
    postings = hits.groupBy("chunk_id", "document_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(whole))  # one row
    idf = frequency.select("term", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = postings.join(idf, "term").join(sized(asked), "term").groupBy("query_id", "chunk_id", "document_id").agg(F.sum(part).alias("score"))
    return top(scored, k)


def all_terms(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Chunks that hold every term of a query, ranked by how often they hold them per word; queries without a term find none."""
    if inrow.fits(queries, "query"):
        return top(inrow.all_terms_rows(chunks, queries, k), k)
    asked = queries.select("query_id", F.array_distinct(terms("query")).alias("wanted")).select("query_id", F.size("wanted").alias("n"), F.explode("wanted").alias("term"))
    words = chunks.select("chunk_id", "document_id", terms("content").alias("words")).withColumn("length", F.size("words"))
    hits = words.select("chunk_id", "document_id", "length", F.explode("words").alias("term")).join(sized(asked.select("term").distinct()), "term", "left_semi").groupBy("chunk_id", "document_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    met = hits.join(sized(asked), "term").groupBy("query_id", "chunk_id", "document_id", "n", "length").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tf"))
    return top(met.where("terms = n").withColumn("score", F.col("tf") / F.col("length")), k).select("query_id", "chunk_id", "document_id", "score", "pos")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays in double precision; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vectors_topk(chunks: DataFrame, queries: DataFrame, k: int, floor: float = -1.0) -> DataFrame:
    """Exact search by cosine: chunks (chunk_id, document_id, embedding), queries (query_id, vector).

    Blocks of chunks are multiplied with the stated queries in the task that
    reads them, which keeps k a query; queries too large for that go to the
    chunks by a join. Score is the certainty (1 + cos) / 2. Null vectors and those of
    another length are left out.
    """
    if inrow.fits(queries, "vector"):
        return top(inrow.cosine_rows(chunks, queries, k, floor, True), k, 6)
    chunks, queries = chunks.where("embedding is not null"), queries.where("vector is not null")
    pairs = chunks.select("chunk_id", "document_id", "embedding").join(sized(queries.select("query_id", "vector")))
    near = pairs.select("query_id", "chunk_id", "document_id", cosine(F.col("embedding"), F.col("vector")).alias("cos")).where(F.col("cos") >= floor)
    return top(near.withColumn("score", (1 + F.col("cos")) / 2), k, 6)


def scaled(leg: DataFrame) -> DataFrame:
    """Scores of a leg scaled to 0..1 within each query; 1 where all are equal."""
    low, high = F.min("score").over(Window.partitionBy("query_id")), F.max("score").over(Window.partitionBy("query_id"))
    return leg.withColumn("scaled", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def hybrid(keyword: DataFrame, vector: DataFrame, k: int, alpha: float = ALPHA) -> DataFrame:
    """``alpha`` parts of the scaled vector score and the rest of the keyword score; a missing leg counts 0."""
    kw = scaled(keyword).select("query_id", "chunk_id", F.col("document_id").alias("kw_doc"), F.col("score").alias("bm25_score"), F.col("scaled").alias("kw"))
    vc = scaled(vector).select("query_id", "chunk_id", F.col("document_id").alias("vc_doc"), F.col("score").alias("vector_similarity"), F.col("scaled").alias("vc"))
    both = kw.join(vc, ["query_id", "chunk_id"], "full")
    score = alpha * F.coalesce("vc", F.lit(0.0)) + (1 - alpha) * F.coalesce("kw", F.lit(0.0))
    return top(both.select("query_id", "chunk_id", F.coalesce("kw_doc", "vc_doc").alias("document_id"), score.alias("score"), "bm25_score", "vector_similarity"), k)


def boosted(results: DataFrame, uses: DataFrame, weight: float) -> DataFrame:
    """Scores times the reuse multiplier, rounded, in a new stable order; uses: chunk_id, reuse_count."""
    if weight <= 0:
        return results
    more = results.join(uses, "chunk_id", "left").withColumn("score", F.round(F.col("score") * reuse_multiplier(F.col("reuse_count"), weight), 4))
    return more.drop("reuse_count").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pos")))


def diversified(results: DataFrame, limit: int) -> DataFrame:
    """The page of each query, documents taking turns in the order of their best result; as it is if it all fits."""
    query, doc = Window.partitionBy("query_id"), Window.partitionBy("query_id", "document_id")
    marked = results.withColumns({"n": F.count(F.lit(1)).over(query), "turn": F.row_number().over(doc.orderBy("pos")), "first": F.min("pos").over(doc)})
    fits = F.col("n") <= limit
    order = [F.when(fits, F.col("pos")).otherwise(F.col("turn")), F.when(fits, F.lit(0)).otherwise(F.col("first"))]
    page = marked.withColumn("pos", F.row_number().over(query.orderBy(*order)))
    return page.where(F.col("pos") <= limit).drop("n", "turn", "first")


def merged(results: Sequence[DataFrame], limit: int) -> DataFrame:
    """Results of several workspaces as one page a query: by score, then chunk, then document."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id", "document_id")
    return every.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def isolated(searches: Mapping[str, Callable[[], DataFrame]], limit: int, fatal: tuple[type[Exception], ...] = ()) -> tuple[DataFrame | None, dict[str, str]]:
    """Several workspaces' pages merged, and what went wrong in the others: one that fails takes no other with it.

    Each search makes its page, of bounded size, and is worked out before they
    are merged. Errors of the ``fatal`` kinds are raised.
    """
    pages, failures = [], {}
    for workspace, search in searches.items():
        try:
            pages.append(written(search(), "page"))
        except fatal:
            raise
        except Exception as e:  # noqa: BLE001  whatever it is, the other workspaces go on
            failures[workspace] = f"{type(e).__name__}: {e}".splitlines()[0][:300]
    return (merged(pages, limit) if pages else None), failures


def tool_search(searches: Mapping[str, Callable[[], DataFrame]], limit: int) -> tuple[DataFrame | None, str | None]:
    """The path of tools: workspaces one after another, no gate and no retry; a filter that makes no sense is told as a text, not raised."""
    try:
        page, _ = isolated(searches, limit, (ValueError,))
    except ValueError as e:
        return None, str(e)
    return page, None


def verdicts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """For each query: n_results, top_score, confidence, verdict and reason."""
    met = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"), F.max("score").alias("top_score"))
    every = queries.select("query_id").join(met, "query_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    best, n = F.col("top_score"), F.col("n_results")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(best, F.lit(0.0))))
    return every.select("query_id", "n_results", "top_score", confidence.alias("confidence"), gate_verdict(best, n).alias("verdict"), gate_reason(best, n).alias("reason"))


def broadened(limit: int) -> int:
    """The limit of a retry that looks for more results."""
    return min(2 * limit, 100)


def with_fallback(queries: DataFrame, first: DataFrame, keyword: DataFrame | None, wider: DataFrame | None) -> DataFrame:
    """The first results, or those of one retry where the verdict asks for it: a row for each result, with ``strategy`` (null: no retry).

    keyword: the results by keyword, for low confidence; None where the search
    already goes by keyword. wider: those without a least score and up to the
    broadened limit, for too little evidence; None where nothing is left to
    broaden. A retry's results replace the first ones even if there are none.
    """
    told = verdicts(queries, first).select("query_id", "verdict")
    legs, kept = [], told
    for leg, verdict, name in ((keyword, LOW, KEYWORD_RETRY), (wider, INSUFFICIENT, BROADENED)):
        if leg is not None:
            legs.append(leg.join(told.where(F.col("verdict") == verdict).select("query_id"), "query_id", "left_semi").withColumn("strategy", F.lit(name)))
            kept = kept.where(F.col("verdict") != verdict)
    own = first.join(kept.select("query_id"), "query_id", "left_semi").withColumn("strategy", F.lit(None).cast("string"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), legs, own)


def final_verdicts(queries: DataFrame, first: DataFrame, keyword: DataFrame | None, wider: DataFrame | None) -> DataFrame:
    """For each query the verdict on what :func:`with_fallback` gives, and the strategy: the retry is judged anew, but never retried."""
    shown = with_fallback(queries, first, keyword, wider)
    before = verdicts(queries, first)
    retried = F.lit(None).cast("string")
    for leg, verdict, name in ((keyword, LOW, KEYWORD_RETRY), (wider, INSUFFICIENT, BROADENED)):
        if leg is not None:
            retried = F.when(F.col("verdict") == verdict, name).otherwise(retried)
    told = before.select("query_id", retried.alias("strategy"))
    return verdicts(queries, shown).join(told, "query_id")


def window_ranges(matches: DataFrame, k: int) -> DataFrame:
    """For matches (document_id, chunk_index) the merged ranges of indices within k, touching ones as one: document_id, lo, hi."""
    key, order = ["document_id"], ["lo", "hi"]
    spans = matches.select("document_id", F.greatest(F.col("chunk_index") - k, F.lit(0)).alias("lo"), (F.col("chunk_index") + k).alias("hi")).distinct()
    told = scans.greatest_before(scans.ranged(spans, key, order), key, order, "hi", "reach")
    opens = F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach") + 1), 1).otherwise(0)
    found = scans.running_sum(told, key, order, opens, "island")
    return found.groupBy("document_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def window_chunks(matches: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """For each match the contents within k before and after: document_id, chunk_index, before, after (arrays in order)."""
    own = matches.select("document_id", "chunk_index").distinct()
    steps = own.withColumn("other", F.explode(F.sequence(F.col("chunk_index") - k, F.col("chunk_index") + k))).where("other <> chunk_index")
    near = steps.join(chunks.select("document_id", F.col("chunk_index").alias("other"), "content"), ["document_id", "other"])
    side = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("other", "content")))), lambda x: x["content"])
    found = near.groupBy("document_id", "chunk_index").agg(side(F.col("other") < F.col("chunk_index")).alias("before"), side(F.col("other") > F.col("chunk_index")).alias("after"))
    empty = F.array().cast("array<string>")
    return own.join(found, ["document_id", "chunk_index"], "left").select("document_id", "chunk_index", F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after"))


def character_places(chunks: DataFrame) -> DataFrame:
    """Where each chunk lies in its document's joined text: document_id, chunk_index, content, from_char, to_char; a document of any length is no single task."""
    key, order = ["document_id"], ["chunk_index"]
    rows = scans.ranged(chunks.select("document_id", "chunk_index", "content"), key, order)
    told = scans.running_sum(rows, key, order, F.length("content") + 2, "end")
    return told.select("document_id", "chunk_index", "content", (F.col("end") - 2 - F.length("content")).alias("from_char"), (F.col("end") - 2).alias("to_char"))


def character_page(chunks: DataFrame, offset: int, limit: int) -> DataFrame:
    """The chunks of each document that the characters [offset, offset + limit) of its joined text touch: document_id, chunk_index, content, from_char, to_char.

    Contents are joined by two line feeds; a chunk across a page's edge is on both pages.
    """
    return character_places(chunks).where((F.col("from_char") < offset + limit) & (F.col("to_char") > offset))


def claims_supported(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each claim (claim_id, content) its best evidence (evidence_id, content) by shared claim tokens: claim_id, evidence_id, share, level.

    Evidence is compared in the task that reads it and one row a claim and task
    is shuffled; claims too large for that meet tokens by a join. Of equal
    evidence the least id counts; a claim that shares no token has null evidence
    and share 0.
    """
    if inrow.fits(claims, "content"):
        stop = frozenset(w.encode() for w in STOPWORDS)
        met = inrow.shared_terms_rows(evidence, claims.select(F.col("claim_id").alias("query_id"), F.col("content").alias("query")), lambda w: len(w) >= 2 and w not in stop)
        met = met.select(F.col("query_id").alias("claim_id"), "evidence_id", F.col("score").alias("share"))
    else:
        flat = claims.select("claim_id", claim_tokens("content").alias("tokens")).select("claim_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        met = evidence.select("evidence_id", F.explode(claim_tokens("content")).alias("token")).join(flat, "token").groupBy("claim_id", "n", "evidence_id").agg((F.count(F.lit(1)) / F.col("n")).alias("share"))
    order = Window.partitionBy("claim_id").orderBy(F.col("share").desc(), "evidence_id")
    best = met.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("claim_id", "evidence_id", "share")
    share = F.coalesce("share", F.lit(0.0))
    return claims.select("claim_id").join(best, "claim_id", "left").select("claim_id", "evidence_id", F.round(share, 6).alias("share"), support_level(share).alias("level"))


#: What a citation names, as far as a result has it.
CITED = ("document_id", "chunk_id", "chunk_index", "original_filename", "source_uri", "source_url", "content_hash", "score")


def citation(results: DataFrame, fields: Sequence[str] = CITED) -> Column:
    """A struct of the result's own columns that tell where it is from."""
    return F.struct(*(c for c in fields if c in results.columns))


def lineage(chunk_meta: str, doc_meta: str, key: str, storage_url: Column | None = None) -> Column:
    """A key of the chunk's metadata map, else of the document's; source_uri else the place where the document is stored."""
    told = F.coalesce(F.try_element_at(F.col(chunk_meta), F.lit(key)), F.try_element_at(F.col(doc_meta), F.lit(key)))
    return F.coalesce(told, storage_url) if key == "source_uri" and storage_url is not None else told


def nearest_others(vectors: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.92) -> DataFrame:
    """For each query vector its k nearest vectors of other documents with at least ``floor``: query_id, chunk_id, document_id, cos, pos.

    queries: query_id, query_document, vector. Rows without a vector or document are left out.
    Queries too large to be sent to the vectors meet them in buckets of random
    projections where the floor is NEAR or more, which misses few pairs; below
    that they are compared with every vector.
    """
    if inrow.fits(queries, "vector"):
        near = inrow.cosine_rows(vectors, queries, k, floor, False, "query_document").withColumnRenamed("score", "cos")
        order = Window.partitionBy("query_id").orderBy(F.col("cos").desc(), "chunk_id")
        return near.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
    if floor >= NEAR:
        return vector_index.near_pairs(vectors, queries, k, floor)
    vectors, queries = vectors.where("embedding is not null"), queries.where("vector is not null")
    pairs = vectors.select("chunk_id", "document_id", "embedding").join(sized(queries), F.col("document_id") != F.col("query_document"))
    near = pairs.select("query_id", "chunk_id", "document_id", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("cos")).where(F.col("cos") >= floor)
    order = Window.partitionBy("query_id").orderBy(F.col("cos").desc(), "chunk_id")
    return near.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
