"""Lookups of documents, chunks and conversations, and what a search result shows.

Every lookup names its workspace or tenant: a blank one raises rather than
widening it. Pages go by a time, newest first, and a key that makes them stable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.text import is_stale, sanitise_url
from siftloom.operators.search import character_places, in_scope


def every(conditions: Sequence[Column | None]) -> Column:
    """All conditions that are given, as one; true without any."""
    told = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, told) if told else F.lit(True)


def of_documents(rows: DataFrame, document_ids: Sequence | None, column: str = "document_id") -> DataFrame:
    """Rows of the named documents, by their whole ids; all rows where none is named."""
    return rows.where(F.col(column).isin(list(document_ids))) if document_ids else rows


def document(documents: DataFrame, document_id: object, workspace: str | None = None) -> DataFrame:
    """The document with an id, of a workspace if one is given; nothing tells a foreign document from none."""
    rows = documents if workspace is None else in_scope(documents, workspace)
    return rows.where(F.col("document_id") == F.lit(document_id))


def conversation(documents: DataFrame, workspace: str, external_id: str) -> DataFrame:
    """The conversation under an external id, with the counts of its metadata: turn_count (0 without) and last_flushed_at."""
    rows = in_scope(documents, workspace).where((F.col("external_id") == external_id) & (F.col("document_type") == "conversation"))
    meta = lambda key: F.try_element_at("metadata", F.lit(key))
    return rows.select(
        "document_id", "workspace_id", "external_id", "status", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce(meta("turn_count").try_cast("int"), F.lit(0)).alias("turn_count"), meta("last_flushed_at").alias("last_flushed_at"),
    )


def document_chunks(chunks: DataFrame, documents: DataFrame, workspace: str) -> DataFrame:
    """Chunks of a workspace's documents, with the columns of their document beside them."""
    own = in_scope(documents, workspace)
    more = [c for c in own.columns if c == "document_id" or c not in chunks.columns]
    return chunks.join(own.select(*more), "document_id")


def chunks_of(chunks: DataFrame, documents: DataFrame, workspace: str, document_id: object) -> DataFrame:
    """The chunks of one document in order, if it is the workspace's."""
    own = document(documents, document_id, workspace).select("document_id")
    return chunks.where(F.col("document_id") == F.lit(document_id)).join(own, "document_id", "left_semi").orderBy("chunk_index")


def tenant_documents(documents: DataFrame, tenant: str, workspace: str | None = None, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A tenant's documents newest first, of a workspace and with a status where they are given."""
    rows = in_scope(documents, tenant, "tenant_id")
    rows = rows if workspace is None else in_scope(rows, workspace)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), "document_id").offset(offset).limit(limit)


def totalled_page(rows: DataFrame, at: str, tie: str, offset: int, limit: int) -> DataFrame:
    """A page newest first with the number of all rows as ``total``; a page behind the end is empty.

    Rows are counted by one aggregate and only a page's rows are sorted out.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(F.col(at).desc(), tie).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def existing(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """Those of the keys (document_id, chunk_index) that are stored."""
    return keys.join(chunks.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_semi")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many chunks each document has, and the index that an append goes on from: document_id, chunk_count, next_index."""
    found = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), (F.max("chunk_index") + 1).alias("next_index"))
    told = documents.select("document_id").distinct().join(found, "document_id", "left")
    return told.select("document_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("next_index", F.lit(0)).alias("next_index"))


def in_flight(documents: DataFrame, statuses: Sequence[str] = ("pending", "processing")) -> DataFrame:
    return documents.where(F.col("status").isin(*statuses))


def ranged_chunks(chunks: DataFrame, documents: DataFrame, ranges: DataFrame, owner: str) -> DataFrame:
    """Chunks of an owner's documents whose index lies in one of the ranges (document_id, lo, hi): each once, in order."""
    own = in_scope(documents, owner, "owner_id").select("document_id")
    asked = ranges.join(own, "document_id", "left_semi")
    c, r = chunks.alias("c"), asked.alias("r")
    met = c.join(r, (F.col("c.document_id") == F.col("r.document_id")) & F.col("c.chunk_index").between(F.col("r.lo"), F.col("r.hi")), "left_semi")
    return met.orderBy("document_id", "chunk_index")


def idle_tenants(tenants: DataFrame, now: Column, days: int) -> DataFrame:
    """Active tenants without activity for ``days``, the longest idle first; days_idle as whole days."""
    last, now = F.col("last_activity_at").cast("timestamp"), now.cast("timestamp")
    rows = tenants.where((F.col("status") == "active") & (last < now - F.expr(f"INTERVAL {int(days)} DAYS")))
    return rows.withColumn("days_idle", F.floor((now.cast("double") - last.cast("double")) / 86_400)).orderBy("last_activity_at", "tenant_id")


def workspace_page(workspaces: DataFrame, documents: DataFrame) -> DataFrame:
    """Every workspace with its number of documents, 0 without any."""
    counts = documents.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("documents"))
    return workspaces.join(counts, "workspace_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def workspaces_by_name(workspaces: DataFrame, documents: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the workspaces (workspace_id, name) by name, with their numbers of documents and the number of all as ``total``; only the page's documents are counted."""
    total = workspaces.agg(F.count(F.lit(1)).alias("total"))
    found = workspaces.orderBy("name", "workspace_id").offset(max(offset, 0)).limit(max(limit, 0))
    counts = documents.join(F.broadcast(found.select("workspace_id")), "workspace_id", "left_semi").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("documents"))  # a page
    told = found.join(counts, "workspace_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    return told.join(F.broadcast(total))  # one row


def within_quota(documents: DataFrame, allowed: Sequence[str], limit: int) -> DataFrame:
    """How many documents the allowed workspaces have, and whether one more is within the limit: used, limit, allowed."""
    used = documents.where(F.col("workspace_id").isin(*allowed)).agg(F.count(F.lit(1)).alias("used"))
    return used.select("used", F.lit(limit).cast("long").alias("limit"), (F.col("used") < limit).alias("allowed"))


#: What a result shows of its own; all else goes into its metadata.
CORE = ("query_id", "chunk_id", "document_id", "original_filename", "content", "score", "pos")


def at_least(results: DataFrame, min_score: float) -> DataFrame:
    """Results that reach a score; taken before any boost."""
    return results.where(F.col("score") >= min_score)


def tag_map(tags: str | Column) -> Column:
    """An array of ``field=value`` as a map, the last of equal fields; what has no ``=`` is left out, and null stands for no tags."""
    t = F.col(tags) if isinstance(tags, str) else tags
    pairs = F.transform(F.filter(t, lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.regexp_extract(x, "(?s)^([^=]*)=", 1).alias("k"), F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    entries = F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]))
    return F.when(F.size(pairs) > 0, F.map_from_entries(entries))


def shown(results: DataFrame, now: Column, stale_days: int = 90) -> DataFrame:
    """Results as they are given out: the core columns, metadata (all other columns as text, nulls left out) and what is read from them.

    source_url is checked again; is_stale by ingested_at, never for conversations;
    content_risk is null where it is ``none``, and its reasons with it; tags as a map.
    Columns that ``results`` lacks count as null.
    """
    has = lambda c, kind="string": F.col(c) if c in results.columns else F.lit(None).cast(kind)
    more = [c for c in results.columns if c not in CORE]
    text = lambda c: F.to_json(F.col(c)) if results.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string")
    entries = F.filter(F.array(*(F.struct(F.lit(c).alias("k"), text(c).alias("v")) for c in more)), lambda e: e["v"].isNotNull()) if more else F.array().cast("array<struct<k:string,v:string>>")
    risk = F.when(~has("content_risk").isin("none", ""), has("content_risk"))
    reasons = has("content_risk_reasons", "array<string>")
    return results.select(
        *(c for c in CORE if c in results.columns),
        F.map_from_entries(entries).alias("metadata"),
        has("content_hash").alias("content_hash"),
        has("source_uri").alias("source_uri"),
        sanitise_url(has("source_url")).alias("source_url"),
        is_stale(has("ingested_at", "timestamp"), F.coalesce(has("content_type"), F.lit("")), now, stale_days).alias("is_stale"),
        risk.alias("content_risk"),
        F.when(risk.isNotNull() & (F.size(reasons) > 0), reasons).alias("content_risk_reasons"),
        tag_map(has("tags", "array<string>")).alias("tags"),
        F.coalesce(has("reuse_count", "int"), F.lit(0)).alias("reuse_count"),
    )


def provenance(results: DataFrame, mode: str, alpha: float | None = None) -> DataFrame:
    """Where scores come from: score_source, bm25_score, vector_similarity and alpha; what the mode does not have is null.

    mode: keyword, hybrid or semantic. Raises ValueError for another one.
    """
    sources = {"keyword": "bm25", "hybrid": "hybrid", "semantic": "vector"}
    if mode not in sources:
        raise ValueError(f"no search mode {mode!r}")
    none = F.lit(None).cast("double")
    kept = lambda c, mine: F.when(F.col(c) > 0, F.col(c)) if c in results.columns else F.when(F.col("score") > 0, F.col("score")) if mine else none
    return results.withColumns({
        "score_source": F.lit(sources[mode]),
        "bm25_score": none if mode == "semantic" else kept("bm25_score", mode == "keyword"),
        "vector_similarity": none if mode == "keyword" else kept("vector_similarity", mode == "semantic"),
        "alpha": F.lit(alpha).cast("double") if mode == "hybrid" else none,
    })


# Keys of a chunk's metadata, and those that only turns of conversations have.
SIGNALS = ("content_risk", "content_risk_reasons", "chunking_strategy", "section_heading", "tags", "turn_index", "turn_id", "role", "turn_ts", "client")


def chunk_metadata(values: Mapping[str, Column]) -> Column:
    """A map of a chunk's signals as text; those that are null or empty, or a risk of ``none`` with its reasons, are left out. Null without any.

    Raises ValueError for a key that is no signal.
    """
    if unknown := sorted(set(values) - set(SIGNALS)):
        raise ValueError(f"no signals: {unknown}")
    risky = F.coalesce(values["content_risk"] != "none", F.lit(False)) if "content_risk" in values else F.lit(True)
    turn = values["turn_id"].isNotNull() if "turn_id" in values else F.lit(True)
    tests = {"content_risk": risky, "content_risk_reasons": risky} | dict.fromkeys(("turn_index", "role", "turn_ts", "client"), turn)
    entries = [F.when(tests.get(k, F.lit(True)) & (F.length(c.cast("string")) > 0), F.struct(F.lit(k).alias("k"), c.cast("string").alias("v"))) for k, c in values.items()]
    told = F.array_compact(F.array(*entries))
    return F.when(F.size(told) > 0, F.map_from_entries(told))


def joined_page(chunks: DataFrame, offset: int, limit: int) -> DataFrame:
    """The characters [offset, offset + limit) of each document's chunks joined by two line feeds: document_id, content, total_chars, truncated, offset, next_offset.

    The offset is held within the text. A page that is not the last ends in a
    note, beyond the limit, of where the next one begins.
    """
    placed = character_places(chunks)
    totals = placed.groupBy("document_id").agg(F.max("to_char").alias("total_chars"))
    # the joint before or behind a chunk may be all that a page has of it
    touched = placed.where((F.col("from_char") - 2 < offset + limit) & (F.col("to_char") + 2 > offset))
    parts = touched.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("x"), F.min("from_char").alias("first"))
    rows = totals.join(parts, "document_id", "left").withColumns({"offset": F.least(F.lit(max(offset, 0)).cast("long"), "total_chars"), "to": F.least(F.lit(offset + limit).cast("long"), "total_chars")})
    rows = rows.withColumn("truncated", F.col("to") < F.col("total_chars"))
    page = F.coalesce(F.substr(F.array_join("x.content", "\n\n"), (F.col("offset") - F.col("first") + 1).cast("int"), (F.col("to") - F.col("offset")).cast("int")), F.lit(""))
    note = F.format_string("\n\n[...truncated: showing chars %d-%d of %d; request offset=%d for more...]", "offset", "to", "total_chars", "to")
    return rows.select("document_id", F.when(F.col("truncated"), F.concat(page, note)).otherwise(page).alias("content"), "total_chars", "truncated", "offset", F.when(F.col("truncated"), F.col("to")).alias("next_offset"))
