"""Queries over lookups, result shapes and the life of records. Orders stand for documents, customers for workspaces and tenants, events for logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions import text as fn
from siftloom.operators import evaluation, lifecycle, lookups, search, stats, stored, tables, tagging
from siftloom.plans.registry import Tables, query
from siftloom.plans.texts import TAG_RULES
from siftloom.session import dealt, shared_folder
from siftloom.streaming import limits

NOW = "2024-02-01 00:00:00"


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def _pick(words: tuple, key: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.col(key) % len(words) + 1).cast("int"))


def _orders(t: Tables) -> DataFrame:
    """Orders as documents."""
    return t.orders.select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("workspace_id"), F.col("o_orderpriority").alias("tenant_id"), (F.col("o_custkey") % 25).cast("string").alias("owner_id"),
        F.concat(F.lit("x"), (F.col("o_custkey") % 500).cast("string")).alias("external_id"), _pick(("conversation", "file"), "o_orderkey").alias("document_type"), _pick(("pending", "processing", "processed", "failed"), "o_orderkey").alias("status"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") % 90).alias("active_run_id"), F.lit(None).cast("string").alias("error_message"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("processed_at"), (F.col("o_custkey") % 40).alias("chunk_count"), F.when(F.col("o_orderkey") % 4 == 0, F.create_map(F.lit("turn_count"), (F.col("o_custkey") % 9).cast("string"))).alias("metadata"),
    )


_ORDERS = """d AS (SELECT o_orderkey AS document_id, o_orderstatus AS workspace_id, o_orderpriority AS tenant_id, (o_custkey % 25)::VARCHAR AS owner_id, 'x' || o_custkey % 500 AS external_id, ['conversation', 'file'][1 + o_orderkey % 2] AS document_type,
 ['pending', 'processing', 'processed', 'failed'][1 + o_orderkey % 4] AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 90 END AS active_run_id, o_orderdate AS created_at, o_custkey % 40 AS chunk_count, CASE WHEN o_orderkey % 4 = 0 THEN (o_custkey % 9)::INT ELSE 0 END AS turn_count FROM orders)"""


def _lines(t: Tables) -> DataFrame:
    """Line items as chunks, each key once."""
    kept = dealt(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    return kept.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.concat(F.lit("part "), F.col("part").cast("string")).alias("content"))


_LINES = "c AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, 'part ' || min(l_partkey) AS content FROM lineitem GROUP BY 1, 2)"


# -- filters and lookups --------------------------------------------------


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3')")
def tag_filtered(t: Tables) -> DataFrame:
    tagged = t.documents.withColumn("tags", F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source")))
    return tagged.where(search.tag_filter("tags", {"lang": ["en", "fr"], "source": ["src1", "src2", "src3"]}, ["lang", "source"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'src1' AND n_chars >= 500 AND doc_id IN (1, 3, 5, 7, 11, 100, 101, 102, 103, 104, 105, 200, 201)")
def composed_filter(t: Tables) -> DataFrame:
    own = lookups.of_documents(search.in_scope(t.documents, "src1", "source"), [1, 3, 5, 7, 11, *range(100, 106), 200, 201], "doc_id")
    return own.where(lookups.every([F.col("n_chars") >= 500, None])).select("doc_id")


@query("SELECT c_custkey AS workspace_id FROM customer WHERE c_nationkey = 7 OR (c_custkey % 25 = 7 AND c_custkey % 5 < 4) ")
def accessible_workspaces(t: Tables) -> DataFrame:
    member = F.struct((F.col("c_custkey") % 25).cast("string").alias("user_id"), _pick(("viewer", "member", "admin", "owner", "guest"), "c_custkey").alias("role"))
    spaces = t.customer.select(F.col("c_custkey").alias("workspace_id"), F.col("c_nationkey").cast("string").alias("owner_id"), F.array(member).alias("members"))
    return tables.accessible(spaces, "7").select("workspace_id")


@query(f"WITH {_ORDERS} SELECT document_id, status, created_at FROM d WHERE workspace_id = 'F' AND document_id = 1")
def document_by_id(t: Tables) -> DataFrame:
    return lookups.document(_orders(t), 1, "F").select("document_id", "status", "created_at")


@query(f"WITH {_ORDERS} SELECT document_id, workspace_id, external_id, status, chunk_count, turn_count, NULL::VARCHAR AS last_flushed_at FROM d WHERE workspace_id = 'O' AND external_id = 'x8' AND document_type = 'conversation'")
def conversation_by_external_id(t: Tables) -> DataFrame:
    return lookups.conversation(_orders(t), "O", "x8")


@query(f"WITH {_ORDERS}, {_LINES} SELECT c.*, tenant_id, status FROM c JOIN d USING (document_id) WHERE workspace_id = 'P'")
def workspace_chunks(t: Tables) -> DataFrame:
    return lookups.document_chunks(_lines(t), _orders(t), "P").select("document_id", "chunk_index", "content", "tenant_id", "status")


@query(f"WITH {_ORDERS}, {_LINES} SELECT c.* FROM c JOIN d USING (document_id) WHERE workspace_id = 'F' AND document_id = 1 ORDER BY chunk_index")
def chunks_of_document(t: Tables) -> DataFrame:
    return lookups.chunks_of(_lines(t), _orders(t), "F", 1)


@query(f"WITH {_ORDERS}, {_LINES} SELECT c.document_id, c.chunk_index, c.content, status FROM c JOIN d USING (document_id) WHERE workspace_id = 'F' AND document_id = 1")
def stored_chunks_of_document(t: Tables) -> DataFrame:
    """One document's chunks from tables laid out by workspace and document: one bucket of each is read."""
    path = shared_folder(t.spark, "stored")
    orders = _orders(t).select("document_id", "workspace_id", "status")
    stored.put(orders, f"{path}/documents", buckets=4)
    stored.put(_lines(t).join(orders.select("document_id", "workspace_id"), "document_id"), f"{path}/chunks", order=["chunk_index"], buckets=4)
    own = stored.of_document(t.spark, f"{path}/documents", "F", 1).select("document_id", "status")
    return stored.of_document(t.spark, f"{path}/chunks", "F", 1).join(own, "document_id").select("document_id", "chunk_index", "content", "status")


@query("""WITH e AS (SELECT event_id, user_id % 20 AS workspace_id, ts FROM events WHERE ts > TIMESTAMP '2024-02-01' - INTERVAL 20 DAY)
SELECT event_id, workspace_id, ts AS created_at FROM e WHERE workspace_id IN (3, 4) ORDER BY ts DESC, event_id DESC LIMIT 50""")
def captured_events_page(t: Tables) -> DataFrame:
    """The newest captured events of a caller's workspaces, after those past their time have gone."""
    events = t.events.select("event_id", (F.col("user_id") % 20).alias("workspace_id"), F.col("ts").alias("created_at"))
    return lifecycle.events_of(lifecycle.events_kept(events, _now(), 20), [3, 4], limit=50)


@query(f"WITH {_ORDERS} SELECT document_id, workspace_id, status, created_at FROM d WHERE tenant_id = '5-LOW' AND workspace_id = 'O' AND status = 'pending' ORDER BY created_at DESC, document_id LIMIT 100 OFFSET 20")
def documents_by_tenant(t: Tables) -> DataFrame:
    return lookups.tenant_documents(_orders(t), "5-LOW", "O", "pending", 100, 20).select("document_id", "workspace_id", "status", "created_at")


@query(f"WITH {_ORDERS}, n AS (SELECT count(*) AS total FROM d) SELECT document_id, created_at, total FROM d, n ORDER BY created_at DESC, document_id LIMIT 50 OFFSET 100")
def page_with_total(t: Tables) -> DataFrame:
    return lookups.totalled_page(_orders(t).select("document_id", "created_at"), "created_at", "document_id", 100, 50)


@query(f"WITH {_LINES} SELECT o_orderkey AS document_id, (1 + o_custkey % 7)::INT AS chunk_index FROM orders WHERE EXISTS (SELECT 1 FROM c WHERE c.document_id = o_orderkey AND c.chunk_index = 1 + o_custkey % 7)")
def existing_chunks(t: Tables) -> DataFrame:
    keys = t.orders.select(F.col("o_orderkey").alias("document_id"), (1 + F.col("o_custkey") % 7).cast("int").alias("chunk_index"))
    return lookups.existing(keys, _lines(t))


@query(f"WITH {_LINES} SELECT o_orderkey AS document_id, count(chunk_index) AS chunk_count, coalesce(max(chunk_index) + 1, 0)::INT AS next_index FROM orders LEFT JOIN c ON document_id = o_orderkey GROUP BY 1")
def chunk_counts(t: Tables) -> DataFrame:
    return lookups.chunk_counts(_orders(t), _lines(t))


@query(f"WITH {_ORDERS} SELECT document_id, status FROM d WHERE status IN ('pending', 'processing')")
def in_flight_documents(t: Tables) -> DataFrame:
    return lookups.in_flight(_orders(t)).select("document_id", "status")


@query(f"WITH {_ORDERS}, {_LINES}, r AS (SELECT document_id, lo, lo + 1 AS hi FROM (SELECT document_id, unnest([document_id % 4, document_id % 5]) AS lo FROM d WHERE owner_id = '3')) SELECT DISTINCT c.document_id, chunk_index, content FROM c JOIN r ON c.document_id = r.document_id AND chunk_index BETWEEN lo AND hi")
def ranged_chunks(t: Tables) -> DataFrame:
    lo = F.explode(F.array(F.col("document_id") % 4, F.col("document_id") % 5))
    ranges = _orders(t).select("document_id", lo.alias("lo")).withColumn("hi", F.col("lo") + 1)
    return lookups.ranged_chunks(_lines(t), _orders(t), ranges, "3")


@query(f"""WITH a AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id AS tenant_id, last AS last_activity_at, floor(epoch(TIMESTAMP '{NOW}' - last) / 86400)::BIGINT AS days_idle FROM a WHERE user_id % 3 > 0 AND last < TIMESTAMP '{NOW}' - INTERVAL 2 DAY ORDER BY last, user_id""")
def idle_tenants(t: Tables) -> DataFrame:
    last = t.events.groupBy(F.col("user_id").alias("tenant_id")).agg(F.max("ts").alias("last_activity_at")).withColumn("status", F.when(F.col("tenant_id") % 3 > 0, "active").otherwise("closed"))
    return lookups.idle_tenants(last, _now(), 2).select("tenant_id", "last_activity_at", "days_idle")


@query("SELECT c_custkey AS workspace_id, count(o_orderkey) AS documents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def workspaces_with_counts(t: Tables) -> DataFrame:
    return lookups.workspace_page(t.customer.select(F.col("c_custkey").alias("workspace_id")), t.orders.select(F.col("o_custkey").alias("workspace_id")))


@query("WITH w AS (SELECT c_custkey AS workspace_id, c_name AS name, count(o_orderkey) AS documents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT *, count(*) OVER () AS total FROM w ORDER BY name, workspace_id LIMIT 25 OFFSET 50")
def workspaces_page(t: Tables) -> DataFrame:
    spaces = t.customer.select(F.col("c_custkey").alias("workspace_id"), F.col("c_name").alias("name"))
    return lookups.workspaces_by_name(spaces, t.orders.select(F.col("o_custkey").alias("workspace_id")), 50, 25)


@query("SELECT count(*) AS used, 1000::BIGINT AS \"limit\", count(*) < 1000 AS allowed FROM orders WHERE o_orderstatus IN ('F', 'P')")
def quota_limit(t: Tables) -> DataFrame:
    return lookups.within_quota(_orders(t), ["F", "P"], 1000)


# -- what results show ----------------------------------------------------

_TAGS = "['lang=' || lang, 'odd', 'source=' || source]"


@query(f"""SELECT doc_id AS chunk_id, source AS document_id, lang AS meta_lang, 'https://x.example/' || doc_id AS source_url, n_chars % 7 > 2 AND n_chars % 3 > 0 AS is_stale,
CASE WHEN n_chars % 4 IN (0, 1) THEN ['low', 'high'][1 + n_chars % 4] END AS content_risk, lang AS tag_lang, source AS tag_source, CASE WHEN n_chars % 4 IN (0, 1) THEN 'a,b' END AS reasons, (n_chars % 5)::INT AS reuse_count FROM documents""")
def results_shown(t: Tables) -> DataFrame:
    rows = t.documents.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("text").alias("content"), F.lit(0.5).alias("score"), "lang", F.concat(F.lit(" https://x.example/"), "doc_id").alias("source_url"),
        F.when(F.col("n_chars") % 7 > 2, F.lit("2023-01-01").cast("timestamp")).otherwise(_now()).alias("ingested_at"), F.when(F.col("n_chars") % 3 == 0, "conversation").otherwise("text/plain").alias("content_type"),
        _pick(("low", "high", "none", ""), "n_chars").alias("content_risk"), F.array(F.lit("a"), F.lit("b")).alias("content_risk_reasons"), F.array(F.concat(F.lit("lang="), "lang"), F.lit("odd"), F.concat(F.lit("source="), "source")).alias("tags"), (F.col("n_chars") % 5).cast("int").alias("reuse_count"),
    )
    got = lookups.shown(rows, _now())
    return got.select("chunk_id", "document_id", F.col("metadata")["lang"].alias("meta_lang"), "source_url", "is_stale", "content_risk", F.col("tags")["lang"].alias("tag_lang"), F.col("tags")["source"].alias("tag_source"), F.array_join("content_risk_reasons", ",").alias("reasons"), "reuse_count")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'hybrid' AS score_source, CASE WHEN l_discount > 0 THEN l_discount END AS bm25_score, CASE WHEN l_tax > 0 THEN l_tax END AS vector_similarity, 0.7::DOUBLE AS alpha FROM lineitem""")
def result_provenance(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("score"), F.col("l_discount").alias("bm25_score"), F.col("l_tax").alias("vector_similarity"))
    return lookups.provenance(rows, "hybrid", 0.7).drop("score")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount >= 0.05")
def results_at_least(t: Tables) -> DataFrame:
    return lookups.at_least(t.lineitem.withColumn("score", F.col("l_discount")), 0.05).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT doc_id, CASE WHEN n_chars % 4 IN (1, 2) THEN ['low', 'high'][n_chars % 4] END AS risk, source AS strategy, CASE WHEN lang <> 'en' THEN lang END AS heading, CASE WHEN doc_id % 2 = 0 THEN 'user' END AS role FROM documents""")
def chunk_metadata_built(t: Tables) -> DataFrame:
    built = lookups.chunk_metadata({
        "content_risk": _pick(("none", "low", "high", ""), "n_chars"), "chunking_strategy": F.col("source"), "section_heading": F.when(F.col("lang") == "en", "").otherwise(F.col("lang")),
        "turn_id": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), "role": F.lit("user"),
    })
    m = t.documents.select("doc_id", built.alias("m"))
    return m.select("doc_id", F.col("m")["content_risk"].alias("risk"), F.col("m")["chunking_strategy"].alias("strategy"), F.col("m")["section_heading"].alias("heading"), F.col("m")["role"].alias("role"))


@query("""WITH p AS (SELECT conv_id AS document_id, string_agg(text, E'\\n\\n' ORDER BY turn) AS whole FROM conversations GROUP BY 1), w AS (SELECT *, length(whole) AS total, least(600, length(whole)) AS a, least(1600, length(whole)) AS b FROM p)
SELECT document_id, substr(whole, a + 1, b - a) || CASE WHEN b < total THEN E'\\n\\n[...truncated: showing chars ' || a || '-' || b || ' of ' || total || '; request offset=' || b || ' for more...]' ELSE '' END AS content,
total::BIGINT AS total_chars, b < total AS truncated, a::BIGINT AS "offset", CASE WHEN b < total THEN b::BIGINT END AS next_offset FROM w""")
def character_pages(t: Tables) -> DataFrame:
    turns = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return lookups.joined_page(turns, 600, 1000)


@query("""SELECT doc_id, doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'chunk' WHEN doc_id % 3 = 1 THEN 'doc' ELSE 'stored/' || doc_id END AS source_uri, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents""")
def result_lineage(t: Tables) -> DataFrame:
    rows = t.documents.select(
        "doc_id", F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("source_uri"), F.lit("chunk"))).alias("cm"),
        F.map_concat(F.when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("source_uri"), F.lit("doc"))).otherwise(F.create_map(F.lit("x"), F.lit("y"))), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), "lang")).otherwise(F.create_map(F.lit("z"), F.lit("y")))).alias("dm"),
    )
    cited = rows.withColumn("c", search.citation(rows))
    return cited.select("doc_id", "c.chunk_id", search.lineage("cm", "dm", "source_uri", F.concat(F.lit("stored/"), "doc_id")).alias("source_uri"), search.lineage("cm", "dm", "lang").alias("lang"))


@query("SELECT l_orderkey AS query_id, sum(l_quantity)::BIGINT AS tokens FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def context_tokens(t: Tables) -> DataFrame:
    return stats.total_tokens(t.orders.select(F.col("o_orderkey").alias("query_id")), t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_quantity").cast("long").alias("token_count")))


@query("""WITH m AS (SELECT o_orderstatus AS status, unnest([{'kind': 'a', 'n': o_custkey % 3}, {'kind': 'b', 'n': 1}]) AS x FROM orders) SELECT status, x.kind AS kind, sum(x.n)::BIGINT AS n FROM m GROUP BY 1, 2""")
def merged_mask_counts(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderstatus").alias("status"), F.create_map(F.lit("a"), F.col("o_custkey") % 3, F.lit("b"), F.lit(1).cast("long")).alias("counts"))
    return stats.merged_counts(rows, "status", "counts")


@query("SELECT doc_id, substr(text, 1, 200) AS a, substr(text, 1, 2000) AS query_text FROM documents")
def recorded_snippets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fn.snippets(F.array("text", "text"))[1].alias("a"), fn.recorded_query("text").alias("query_text"))


@query("""WITH x AS (SELECT event_id, [strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z', strftime(ts, '%Y-%m-%d %H:%M:%S'), 'no time', NULL][1 + event_id % 4] AS s, ts FROM events) SELECT event_id, CASE WHEN event_id % 4 < 2 THEN date_trunc('second', ts) END AS at FROM x""")
def parsed_times(t: Tables) -> DataFrame:
    stamp = lambda form: F.date_format("ts", form)
    told = F.element_at(F.array(F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), stamp("yyyy-MM-dd HH:mm:ss"), F.lit("no time"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", fn.parse_timestamp(told).cast("timestamp_ntz").alias("at"))


@query("SELECT page_id, page_id % 5 < 4 AS unsafe FROM pages")
def unsafe_paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fn.is_unsafe_path(F.element_at(F.array(*map(F.lit, ("a/../b", "/etc/x", "C:\\x", "..", "a/b..c/d.txt"))), (F.col("page_id") % 5 + 1).cast("int"))).alias("unsafe"))


@query(
    "WITH s AS (SELECT doc_id, lang, " + ", ".join("(" + " + ".join(f"len(regexp_extract_all(lower('Heading' || chr(10) || text), '{p}'))" for p in ps) + f") AS {v}" for v, ps in TAG_RULES.items()) + " FROM documents), b AS (SELECT *, greatest(" + ", ".join(TAG_RULES) + ") AS best FROM s) "
    "SELECT doc_id, 'tongue=' || CASE WHEN best = 0 THEN 'other' " + " ".join(f"WHEN {v} = best THEN '{v}'" for v in TAG_RULES) + " END || CASE WHEN doc_id % 2 = 0 THEN ',written=' || lang ELSE '' END AS tags FROM b"
)
def tagged_by_schema(t: Tables) -> DataFrame:
    rules = tagging.RulesTagger({"tongue": tagging.TagField("enum", (*TAG_RULES, "other"), TAG_RULES), "written": tagging.TagField("string"), "on": tagging.TagField("date")})
    rows = t.documents.select("doc_id", F.lit("Heading").alias("heading"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("written"), "lang")).alias("metadata"))
    return tagging.tagged(rows, rules).select("doc_id", F.array_join("tag_strings", ",").alias("tags"))


# -- life of records ------------------------------------------------------


@query("""WITH k AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2), c AS (SELECT doc_id, chunk_index, 'part ' || part AS content, sha256('part ' || part) AS h FROM k),
e AS (SELECT *, chunk_index % 3 <> 0 AND (chunk_index % 2 = 0 OR doc_id % 2 = 0) AS hit FROM c)
SELECT doc_id, chunk_index, CASE WHEN hit THEN 'new ' || content ELSE content END AS content, CASE WHEN hit THEN sha256('new ' || content) ELSE h END AS content_hash, CASE WHEN hit THEN ceil(greatest(3 * 1.3::DOUBLE, (length(content) + 4) / 4.0::DOUBLE))::BIGINT ELSE 77 END AS token_count, hit AS touched FROM e""")
def edited_chunks(t: Tables) -> DataFrame:
    chunks = _lines(t).withColumnRenamed("document_id", "doc_id").withColumns({"content_hash": fn.content_hash("content"), "token_count": F.lit(77).cast("long"), "ingested_at": F.lit("2020-01-01").cast("timestamp")})
    hashed = F.when(F.col("chunk_index") % 2 == 0, None).otherwise(F.when(F.col("doc_id") % 2 == 0, F.col("content_hash")).otherwise("another"))
    edits = chunks.where("chunk_index % 3 <> 0").select("doc_id", "chunk_index", F.concat(F.lit("new "), "content").alias("content"), hashed.alias("expected_hash"))
    return tables.edited_chunks(chunks, edits, _now()).select("doc_id", "chunk_index", "content", "content_hash", "token_count", (F.col("ingested_at") == _now()).alias("touched"))


@query(f"WITH {_LINES}, m AS (SELECT document_id, max(chunk_index) AS last FROM c GROUP BY 1) SELECT o_orderkey AS doc_id, (coalesce(last, -1) + 1 + n)::INT AS chunk_index, 'more ' || n AS content FROM (SELECT o_orderkey, unnest([0, 1]) AS n FROM orders) LEFT JOIN m ON document_id = o_orderkey")
def appended_indices(t: Tables) -> DataFrame:
    more = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("nth")).withColumn("content", F.concat(F.lit("more "), F.col("nth").cast("string")))
    return tables.next_indices(_lines(t).withColumnRenamed("document_id", "doc_id"), more)


@query(f"""WITH {_ORDERS}, x AS (SELECT document_id, ['processed', 'failed', 'processing'][1 + document_id % 3] AS status, CASE WHEN document_id % 3 = 1 THEN 'broken' END AS error_message, CASE WHEN document_id % 5 > 0 THEN document_id % 90 END AS run_id FROM d WHERE document_id % 2 = 0),
m AS (SELECT d.document_id, x.document_id IS NOT NULL AND (run_id IS NULL OR active_run_id IS NULL OR active_run_id = run_id) AS hit, CASE WHEN hit THEN x.status ELSE d.status END AS status, CASE WHEN hit THEN x.error_message END AS error_message FROM d LEFT JOIN x USING (document_id))
SELECT document_id, status, error_message, hit AND status = 'processed' AS done FROM m""")
def status_changes(t: Tables) -> DataFrame:
    documents = _orders(t)
    asked = documents.where("document_id % 2 = 0")
    changes = asked.select("document_id", _pick(("processed", "failed", "processing"), "document_id").alias("status"), F.when(F.col("document_id") % 3 == 1, "broken").alias("error_message"), F.when(F.col("document_id") % 5 > 0, F.col("document_id") % 90).alias("run_id"))
    return lifecycle.status_changed(documents, changes, _now()).select("document_id", "status", "error_message", F.col("processed_at").isNotNull().alias("done"))


@query("""WITH d AS (SELECT o_orderkey AS document_id, o_orderstatus AS workspace_id, o_orderpriority AS uploaded_by, 'h' || o_custkey AS content_hash, o_custkey AS chunk_count FROM orders),
u AS (SELECT o_orderkey + 9000 AS document_id, 'F' AS workspace_id, CASE WHEN o_custkey % 2 = 0 THEN 'someone' END AS uploaded_by, CASE WHEN o_custkey % 3 = 0 THEN 'n' || o_custkey END AS content_hash FROM orders)
SELECT coalesce(u.document_id, d.document_id) AS document_id, coalesce(u.workspace_id, d.workspace_id) AS workspace_id, coalesce(u.uploaded_by, d.uploaded_by) AS uploaded_by, coalesce(u.content_hash, d.content_hash) AS content_hash,
CASE WHEN u.document_id IS NULL THEN 'processed' ELSE 'pending' END AS status, CASE WHEN u.document_id IS NULL THEN chunk_count ELSE 0 END AS chunk_count, CASE WHEN u.document_id IS NULL THEN 'old' END AS error_message FROM d FULL JOIN u ON d.document_id = u.document_id""")
def pending_documents(t: Tables) -> DataFrame:
    documents = t.orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("workspace_id"), F.col("o_orderpriority").alias("uploaded_by"), F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("content_hash"), F.lit("processed").alias("status"), F.col("o_custkey").alias("chunk_count"), F.lit("old").alias("error_message"))
    uploads = t.orders.select((F.col("o_orderkey") + 9000).alias("document_id"), F.lit("F").alias("workspace_id"), F.when(F.col("o_custkey") % 2 == 0, "someone").alias("uploaded_by"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("n"), F.col("o_custkey").cast("string"))).alias("content_hash"))
    return lifecycle.pending_rows(documents, uploads)


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id IN (SELECT doc_id FROM labels) THEN (vec_id % 9)::INT ELSE 0 END AS reuse_count FROM embeddings")
def reuse_counts_patched(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.lit(0).alias("reuse_count"))
    uses = t.labels.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 9).cast("int").alias("reuse_count")).dropDuplicates(["chunk_id"])
    return lifecycle.reuse_patched(vectors, uses)


@query("""WITH s AS (SELECT user_id, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1)
SELECT coalesce(c_custkey, user_id) AS tenant_id, CASE WHEN c_custkey IS NULL THEN 'active' ELSE 'old' END AS status, coalesce(CASE WHEN c_custkey IS NOT NULL THEN TIMESTAMP '2024-01-05' END, first) AS created_at, greatest(CASE WHEN c_custkey IS NOT NULL THEN TIMESTAMP '2024-01-20' END, last) AS last_activity_at
FROM customer FULL JOIN s ON c_custkey = user_id""")
def tenants_touched(t: Tables) -> DataFrame:
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    tenants = t.customer.select(F.col("c_custkey").alias("tenant_id"), F.lit("old").alias("status"), stamp("2024-01-05").alias("created_at"), stamp("2024-01-20").alias("last_activity_at"))
    return lifecycle.touched(tenants, t.events.select(F.col("user_id").alias("tenant_id"), F.col("ts").alias("at")))


@query("SELECT event_type, count(*) AS n, round(epoch_us(max(ts) - min(ts)) / 1e6::DOUBLE, 3) AS seconds, round(count(*) / (epoch_us(max(ts) - min(ts)) / 1e6::DOUBLE), 6) AS per_second FROM events GROUP BY 1")
def event_throughput(t: Tables) -> DataFrame:
    return stats.throughput(t.events, "event_type", "ts")


@query("SELECT event_id AS message_id, ts AS sent_at FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id")
def topic_history(t: Tables) -> DataFrame:
    return limits.history(t.events.select(F.col("event_id").alias("message_id"), F.col("event_type").alias("topic"), F.col("ts").alias("sent_at")), "purchase").select("message_id", "sent_at")


@query(f"WITH {_ORDERS} SELECT document_id, CASE WHEN workspace_id = 'F' AND document_id % 7 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN workspace_id = 'F' AND document_id % 7 = 0 THEN 'no space' END AS error_message FROM d")
def failed_documents(t: Tables) -> DataFrame:
    failures = _orders(t).where("document_id % 7 = 0").select(F.lit("F").alias("workspace_id"), "document_id", F.lit("no space").alias("error_message"))
    return lifecycle.marked_failed(_orders(t), failures, _now()).select("document_id", "status", "error_message")


@query(f"""WITH {_ORDERS}, {_LINES}, n AS (SELECT document_id, count(*) AS n FROM c GROUP BY 1), g AS (SELECT workspace_id, count(*) AS docs, sum(coalesce(n, 0)) AS chunks FROM d LEFT JOIN n USING (document_id) WHERE owner_id = '3' GROUP BY 1)
SELECT workspace_id, greatest(0, 200 - coalesce(docs, 0))::BIGINT AS documents, greatest(0, 1000 - coalesce(chunks, 0))::BIGINT AS chunks FROM (SELECT DISTINCT workspace_id FROM d) LEFT JOIN g USING (workspace_id)""")
def delete_counters(t: Tables) -> DataFrame:
    documents = _orders(t)
    counters = documents.select("workspace_id").distinct().withColumns({"documents": F.lit(200).cast("long"), "chunks": F.lit(1000).cast("long")})
    return lifecycle.deleted(documents, _lines(t), counters, documents.where("owner_id = '3'"))[2]


@query("""WITH f AS (SELECT user_id AS event_id, event_type AS verdict, event_id AS n, props AS query_text FROM events)
SELECT event_id, arg_max(verdict, n) AS verdict, arg_min(query_text, n) AS query_text FROM f GROUP BY 1""")
def feedback_kept(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("event_id"), F.col("event_type").alias("verdict"), F.array(F.lit("x")).alias("evidence"), F.col("props").alias("query_text"), F.col("event_id").alias("updated_at"))
    return lifecycle.feedback_upserted(rows.where("updated_at % 2 = 0"), rows.where("updated_at % 2 = 1")).select("event_id", "verdict", "query_text")


@query("SELECT o_orderkey AS case_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 AND o_orderdate >= TIMESTAMP '1997-01-01'")
def active_cases(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderstatus").alias("workspace_id"), F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 3 > 0).alias("active"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    off = cases.where("case_id % 5 = 0").select("workspace_id", "case_id", F.lit(False).alias("active"))
    return lifecycle.active_cases(lifecycle.case_toggled(cases, off, _now()), "O", None, F.lit("1997-01-01").cast("timestamp")).select("case_id")


@query("""WITH r AS (SELECT o_orderkey % 50 AS run_id, ['a', 'b'][1 + o_custkey % 2] AS mode, o_custkey % 10 / 10.0 AS recall, o_custkey % 7 / 7.0 AS mrr FROM orders)
SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'finished' ELSE 'failed' END AS status, CASE WHEN run_id % 2 = 0 THEN round(avg(recall) FILTER (mode = 'a'), 6) END AS recall_a, CASE WHEN run_id % 2 = 0 THEN round(avg(mrr::DOUBLE) FILTER (mode = 'b'), 6) END AS mrr_b FROM r GROUP BY 1""")
def eval_runs_finished(t: Tables) -> DataFrame:
    results = t.orders.select((F.col("o_orderkey") % 50).alias("run_id"), _pick(("a", "b"), "o_custkey").alias("mode"), (F.col("o_custkey") % 10 / 10).alias("recall"), (F.col("o_custkey") % 7 / 7).alias("mrr"), F.lit(0.5).alias("ndcg"))
    runs = results.select("run_id").distinct().withColumns({"status": F.when(F.col("run_id") % 2 == 0, "running").otherwise("failed"), "aggregates": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp")})
    done = lifecycle.runs_finished(runs, results, _now())
    of = lambda path: F.get_json_object("aggregates", path).cast("double")
    return done.select("run_id", "status", of("$.a.recall").alias("recall_a"), of("$.b.mrr").alias("mrr_b"))


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def last_eval_run(t: Tables) -> DataFrame:
    return lifecycle.last_run(t.orders.select(F.col("o_orderstatus").alias("workspace_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at")), "F").select("run_id")


@query("SELECT event_id, event_type FROM events WHERE user_id = 8 ORDER BY ts, event_id")
def ingestion_log(t: Tables) -> DataFrame:
    return lifecycle.event_log(t.events.withColumnsRenamed({"user_id": "document_id", "ts": "created_at"}), 8).select("event_id", "event_type")


_LETTERS = "l AS (SELECT event_id AS letter_id, event_type AS workspace_id, CASE WHEN event_id % 9 = 0 THEN 'retrying' ELSE ['pending', 'failed'][1 + event_id % 2] END AS status, CASE WHEN event_id % 9 = 0 THEN event_id % 4 + 1 ELSE event_id % 4 END AS retry_count, ts AS failed_at FROM events)"


@query(f"WITH {_LETTERS} SELECT letter_id, status, retry_count FROM l WHERE workspace_id = 'error' AND status = 'retrying' ORDER BY failed_at DESC, letter_id LIMIT 100")
def dead_letter_page(t: Tables) -> DataFrame:
    letters = t.events.select(F.col("event_id").alias("letter_id"), F.col("event_type").alias("workspace_id"), _pick(("pending", "failed"), "event_id").alias("status"), (F.col("event_id") % 4).alias("retry_count"), F.col("ts").alias("failed_at"))
    tried = lifecycle.letters_retried(letters, letters.where("letter_id % 9 = 0"))
    return lifecycle.letters_page(tried, "error", "retrying").select("letter_id", "status", "retry_count")


@query("SELECT 'orders' AS name, count(*) FILTER (o_orderstatus = 'P') AS removed, 0::BIGINT AS residue, true AS clean FROM orders UNION ALL SELECT 'customer', 0, count(*) FILTER (c_custkey % 3 = 0), count(*) FILTER (c_custkey % 3 = 0) = 0 FROM customer")
def purge_receipt(t: Tables) -> DataFrame:
    before = {"orders": t.orders.withColumnRenamed("o_orderstatus", "workspace_id"), "customer": t.customer.withColumn("workspace_id", F.when(F.col("c_custkey") % 3 == 0, "P").otherwise("x"))}
    after = tables.purged({"orders": before["orders"]}, "P") | {"customer": before["customer"]}
    return lifecycle.purge_receipt(before, after, "P")


@query("""SELECT o_orderkey AS document_id, CASE WHEN o_custkey % 3 = 0 THEN 'document.processed' ELSE 'document.failed' END AS event_type, CASE WHEN o_custkey % 3 = 0 THEN 'ready' ELSE 'failed' END AS status, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 40 ELSE 0 END AS chunks FROM orders""")
def completion_events(t: Tables) -> DataFrame:
    good = F.col("o_custkey") % 3 == 0
    results = t.orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("workspace_id"), F.when(good, True).alias("success"), F.when(good, F.col("o_custkey") % 40).alias("chunk_count"), F.lit(None).cast("string").alias("error"))
    return lifecycle.completions(results).select("document_id", "event_type", "status", F.get_json_object("payload", "$.chunks_created").cast("long").alias("chunks"))


@query(f"""WITH {_LINES}, a AS (SELECT DISTINCT l_orderkey + 20 AS document_id FROM lineitem), n AS (SELECT document_id, count(*) AS n FROM c GROUP BY 1)
SELECT a.document_id, CASE WHEN o_orderkey IS NULL THEN 0 ELSE coalesce(n, 0) END AS chunks, o_orderkey IS NULL OR n IS NULL AS skipped, CASE WHEN o_orderkey IS NULL THEN 'document not found' WHEN n IS NULL THEN 'no chunks stored' END AS reason FROM a LEFT JOIN orders ON o_orderkey = document_id LEFT JOIN n USING (document_id)""")
def reindex_report(t: Tables) -> DataFrame:
    asked = t.lineitem.select((F.col("l_orderkey") + 20).alias("document_id"))
    vectors = _lines(t).select("document_id", "chunk_index")
    return lifecycle.reindexed(_orders(t), _lines(t), vectors, asked)[2]


@query("""WITH p AS (SELECT event_id AS message_id, CASE WHEN event_id % 6 > 0 THEN event_id % 6 END AS deliveries, (value * 1000)::BIGINT AS idle_ms FROM events)
SELECT CASE WHEN idle_ms IS NULL OR idle_ms < 5000 THEN 'waiting' WHEN coalesce(deliveries, 0) < 4 THEN 'again' ELSE 'poison' END AS fate, count(*) AS n FROM p GROUP BY 1""")
def redelivery(t: Tables) -> DataFrame:
    pending = t.events.select(F.col("event_id").alias("message_id"), F.when(F.col("event_id") % 6 > 0, F.col("event_id") % 6).alias("deliveries"), F.round(F.col("value") * 1000).cast("long").alias("idle_ms"))
    legs = limits.reclaimed(pending, 5000, 4)
    named = [x.select(F.lit(n).alias("fate")) for n, x in zip(("again", "poison", "waiting"), legs, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, ts AS start, 1::BIGINT AS nth FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ts >= w.start + INTERVAL 7200 SECOND THEN e.ts ELSE w.start END, CASE WHEN e.ts >= w.start + INTERVAL 7200 SECOND THEN 1 ELSE w.nth + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT event_id, start AS window_start, nth, nth <= 2 AS allowed FROM w""")
def rate_limit_first_hit(t: Tables) -> DataFrame:
    return limits.first_hit_windows(t.events, "user_id", "ts", 2, 7200).select("event_id", "window_start", "nth", "allowed")


# -- evaluation records ---------------------------------------------------


@query("""WITH r AS (SELECT o_custkey % 40 AS query_id, o_orderkey AS document_id, o_custkey AS chunk_id, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders),
x AS (SELECT q AS query_id, unnest([q, q * 40, q + 4000]) AS id FROM range(45) t(q)), m AS (SELECT r.query_id, pos, CASE WHEN document_id IN (SELECT id FROM x WHERE x.query_id = r.query_id) THEN document_id ELSE chunk_id END AS id FROM r),
f AS (SELECT query_id, id, min(pos) AS pos FROM m GROUP BY 1, 2), d AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos, id::VARCHAR) AS pos FROM f), h AS (SELECT x.query_id, min(pos) AS first FROM x LEFT JOIN d ON d.query_id = x.query_id AND d.id = x.id GROUP BY 1)
SELECT h.query_id, CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, (SELECT count(*) FROM r WHERE r.query_id = h.query_id) AS returned FROM h""")
def dataset_eval(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.col("o_custkey") % 40).orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    results = t.orders.select((F.col("o_custkey") % 40).alias("query_id"), F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("chunk_id"), place.alias("pos"))
    expected = t.spark.range(45).select(F.col("id").alias("query_id"), F.explode(F.array(F.col("id"), F.col("id") * 40, F.col("id") + 4000)).alias("id"))
    return evaluation.dataset_eval(results, expected, 5, 0.1)[0]


@query("""WITH r AS (SELECT ['kw', 'vec'][1 + o_orderkey % 2] AS mode, o_custkey % 30 AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderkey % 2, o_custkey % 30 ORDER BY o_totalprice, o_orderkey) AS rank FROM orders),
j AS (SELECT DISTINCT o_custkey % 30 AS query_id, o_orderkey AS id FROM orders WHERE o_totalprice < 20000), w AS (SELECT query_id, count(*) AS n FROM j GROUP BY 1),
h AS (SELECT mode, r.query_id, count(*) FILTER (rank <= 10) AS hits, min(rank) AS first FROM r JOIN j ON r.query_id = j.query_id AND r.id = j.id GROUP BY 1, 2)
SELECT m.mode, round(avg(round(coalesce(hits, 0) / n, 6)), 6) AS recall, round(avg(round(coalesce(1.0::DOUBLE / first, 0), 6)), 6) AS mrr, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0 END), 6) AS hit FROM (SELECT 'kw' AS mode UNION ALL SELECT 'vec') m CROSS JOIN w LEFT JOIN h ON h.mode = m.mode AND h.query_id = w.query_id GROUP BY 1""")
def eval_replay(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(F.col("o_orderkey") % 2, F.col("o_custkey") % 30).orderBy("o_totalprice", "o_orderkey"))
    results = t.orders.select(_pick(("kw", "vec"), "o_orderkey").alias("mode"), (F.col("o_custkey") % 30).alias("query_id"), F.col("o_orderkey").alias("id"), rank.alias("rank"))
    cases = t.orders.where("o_totalprice < 20000").select((F.col("o_custkey") % 30).alias("query_id"), F.col("o_orderkey").alias("id"), F.lit(1).alias("grade"))
    return evaluation.replay_metrics(cases, results, 10).drop("ndcg")


@query("""WITH e AS (SELECT *, user_id % 20 AS workspace_id, ts > TIMESTAMP '2024-01-31' - INTERVAL 10 DAY AS recent FROM events),
f AS (SELECT workspace_id, props, row_number() OVER (PARTITION BY workspace_id ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE event_type = 'error'),
r AS (SELECT workspace_id, event_id, row_number() OVER (PARTITION BY workspace_id ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE event_type = 'signup')
SELECT workspace_id, count(*) FILTER (recent) AS captured, count(*) FILTER (recent AND event_type = 'error') AS feedback, CASE WHEN count(*) FILTER (recent AND event_type = 'error') > 0 THEN 0.0 END::DOUBLE AS answer_rate, count(*) FILTER (event_id % 3 = 0) AS eval_case_count,
count(*) FILTER (event_id % 3 = 0) < 90 AS low_confidence, (SELECT string_agg(props, '|' ORDER BY n) FROM f WHERE f.workspace_id = e.workspace_id AND n <= 5) AS gaps, (SELECT max(event_id) FROM r WHERE r.workspace_id = e.workspace_id AND n = 1) AS last_run FROM e GROUP BY 1""")
def scorecard_gaps(t: Tables) -> DataFrame:
    rows = t.events.withColumns({"workspace_id": F.col("user_id") % 20, "quality_verdict": F.lit(None).cast("string"), "created_at": F.col("ts")})
    said = rows.where("event_type = 'error'").select("workspace_id", "event_id", F.lit("not_relevant").alias("verdict"), F.col("props").alias("query_text"), "created_at")
    cases = rows.select("workspace_id", (F.col("event_id") % 3 == 0).alias("active"))
    runs = rows.where("event_type = 'signup'").select("workspace_id", F.col("event_id").alias("run_id"), F.lit("completed").alias("status"), F.col("ts").alias("started_at"))
    now = F.lit("2024-01-31 00:00:00").cast(t.events.schema["ts"].dataType)
    told = evaluation.full_scorecard(rows, said, cases, runs, now, days=10, least=90)
    return told.select("workspace_id", "captured", "feedback", "answer_rate", "eval_case_count", "low_confidence", F.when(F.size("gaps") > 0, F.array_join("gaps", "|")).alias("gaps"), F.col("last_run.run_id").alias("last_run"))
