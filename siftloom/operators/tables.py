"""Rows of documents, chunks, runs and dead letters: lookups, merges and lifecycle as DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(current: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Incoming rows replace those with their keys; columns of ``keep`` take the old value where the new one is null."""
    both = current.select(*keys, F.struct("*").alias("old")).join(incoming.select(*keys, F.struct("*").alias("new")), list(keys), "full")
    columns = []
    for c in current.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c in keep:
            columns.append(F.coalesce(f"new.{c}", f"old.{c}").alias(c))
        else:
            columns.append(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
    return both.select(*columns)


def appended(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows whose keys are new, each key once: what an append really adds."""
    return incoming.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti")


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def newest(rows: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; ties go to the larger ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def page(rows: DataFrame, at: str, tie: str, offset: int, limit: int) -> DataFrame:
    """Newest first; the tie makes pages stable."""
    return rows.orderBy(F.col(at).desc(), F.col(tie)).offset(offset).limit(limit)


def orphans(processed: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Processed rows that the index lacks altogether."""
    return processed.join(indexed.select(key).distinct(), key, "left_anti")


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the smallest id with its text's hash and how many share it: doc_id, content_hash, first_id, copies."""
    from siftloom.functions.text import content_hash

    hashed = docs.select(F.col(id_col).alias("doc_id"), content_hash(F.coalesce(F.col(text_col), F.lit(""))).alias("content_hash"))
    firsts = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(firsts, "content_hash").select("doc_id", "content_hash", "first_id", "copies")


def intake(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads (workspace_id, filename, content_hash) against known healthy documents: match on hash first, then on file name.

    Adds document_id (null: new) and decision: skip (same content), replace (same name), create.
    """
    by_hash = newest(known, ["workspace_id", "content_hash"], "created_at", "document_id").select("workspace_id", "content_hash", F.col("document_id").alias("same_content"))
    by_name = newest(known, ["workspace_id", "filename"], "created_at", "document_id").select("workspace_id", "filename", F.col("document_id").alias("same_name"))
    met = uploads.join(by_hash, ["workspace_id", "content_hash"], "left").join(by_name, ["workspace_id", "filename"], "left")
    decision = F.when(F.col("same_content").isNotNull(), "skip").when(F.col("same_name").isNotNull(), "replace").otherwise("create")
    return met.select(*uploads.columns, F.coalesce("same_content", "same_name").alias("document_id"), decision.alias("decision"))


def fenced(claims: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes (document_id, run_id, started_at, ...) of the run that holds the document: the newest start, ties to the later run id; documents without a claim admit all."""
    holder = claims.groupBy("document_id").agg(F.max_by("run_id", F.struct("claimed_at", "run_id")).alias("holder"))
    return writes.join(holder, "document_id", "left").where(F.col("holder").isNull() | (F.col("holder") == F.col("run_id"))).drop("holder")


def dead_letters(letters: DataFrame) -> DataFrame:
    """One letter for each (document_id, run_id, dedup_key), the last; those with a null in the key all stay."""
    keys = ["document_id", "run_id", "dedup_key"]
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return newest(letters.where(whole), keys, "failed_at", "letter_id").unionByName(letters.where(~whole))


def resolved(letters: DataFrame, successes: DataFrame) -> DataFrame:
    """Pending and retrying letters of documents that have succeeded become resolved."""
    done = successes.select("document_id").distinct().withColumn("_done", F.lit(True))
    status = F.when(F.col("_done") & F.col("status").isin("pending", "retrying"), "resolved").otherwise(F.col("status"))
    return letters.join(done, "document_id", "left").withColumn("status", status).drop("_done")


def valid_audit(events: DataFrame, required: Sequence[str], sources: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required], F.coalesce(F.col("source").isin(*sources), F.lit(False)))


def audit_log(events: DataFrame, required: Sequence[str], sources: Sequence[str], tie: str) -> DataFrame:
    """Valid events, each audit_id once (the first by ``tie``)."""
    order = Window.partitionBy("audit_id").orderBy(tie)
    return events.where(valid_audit(events, required, sources)).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def accessible(workspaces: DataFrame, user: str) -> DataFrame:
    """Workspaces that the user owns or is a member of with a valid role: members are structs (user_id, role)."""
    member = F.exists("members", lambda m: (m["user_id"] == user) & m["role"].isin("viewer", "member", "admin", "owner"))
    return workspaces.where((F.col("owner_id") == user) | F.coalesce(member, F.lit(False)))


def purged(tables: dict[str, DataFrame], workspace: str) -> dict[str, DataFrame]:
    """The tables without the rows of a workspace. Raises ValueError for a blank name."""
    if not workspace.strip():
        raise ValueError("a workspace must be named")
    return {name: t.where(~F.col("workspace_id").eqNullSafe(workspace)) for name, t in tables.items()}


def retained(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(at) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def edited_chunks(chunks: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Chunks with edits (doc_id, chunk_index, content, expected_hash) applied where the expected hash is null or the chunk's; tokens and hash anew there, all others as stored."""
    from siftloom.functions.text import content_hash, estimate_tokens

    met = chunks.join(edits.select("doc_id", "chunk_index", F.col("content").alias("_new"), F.col("expected_hash")), ["doc_id", "chunk_index"], "left")
    applies = F.col("_new").isNotNull() & (F.col("expected_hash").isNull() | (F.col("expected_hash") == F.col("content_hash")))
    anew = {"content": F.col("_new"), "token_count": estimate_tokens("_new"), "content_hash": content_hash("_new"), "ingested_at": now}
    # one expression for all columns, as each looks at the hash that another replaces
    return met.select("doc_id", "chunk_index", *(F.when(applies, anew[c]).otherwise(F.col(c)).alias(c) if c in anew else F.col(c) for c in chunks.columns if c not in ("doc_id", "chunk_index")))


def next_indices(chunks: DataFrame, additions: DataFrame) -> DataFrame:
    """Additions (doc_id, nth, content) with the indices behind each document's last chunk."""
    last = chunks.groupBy("doc_id").agg(F.max("chunk_index").alias("last"))
    order = Window.partitionBy("doc_id").orderBy("nth")
    return additions.join(last, "doc_id", "left").select("doc_id", (F.coalesce("last", F.lit(-1)) + F.row_number().over(order)).cast("int").alias("chunk_index"), "content")
