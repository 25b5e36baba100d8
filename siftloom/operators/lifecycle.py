"""What happens to documents, evaluation records, dead letters and workspaces over time, as tables before and after.

Changes are keyed and idempotent: applied twice they give the same table. Where
several changes concern one row, the last by time counts, ties by key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.operators.search import in_scope
from siftloom.operators.tables import newest, upserted, without


def changed(rows: DataFrame, changes: DataFrame, keys: Sequence[str], values: Mapping[str, Column], when: Column | None = None) -> DataFrame:
    """The rows with new values where a change has their key and ``when`` holds; in both the change's columns are under ``new``.

    ``changes`` has a row a key at most.
    """
    met = rows.join(changes.select(*keys, F.struct("*").alias("new")), list(keys), "left")
    applies = F.col("new").isNotNull() if when is None else F.col("new").isNotNull() & F.coalesce(when, F.lit(False))
    return met.select(*(F.when(applies, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def status_changed(documents: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Documents with the status and error that a change (document_id, status, error_message, run_id) gives them.

    A change of a run counts where the document is unclaimed (null
    active_run_id) or that run's; one without a run always. processed_at is now
    for ``processed``, else null.
    """
    free = F.col("new.run_id").isNull() | F.col("active_run_id").isNull() | (F.col("active_run_id") == F.col("new.run_id"))
    values = {"status": F.col("new.status"), "error_message": F.col("new.error_message"), "updated_at": now, "processed_at": F.when(F.col("new.status") == "processed", now)}
    return changed(documents, changes, ["document_id"], values, free)


def pending_rows(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """Documents with those that are uploaded (document_id, workspace_id, uploaded_by, content_hash) made or set back to ``pending``, without chunks and errors.

    An upload that does not name who uploaded it, or its hash, leaves what is stored.
    """
    made = uploads.select("document_id", "workspace_id", "uploaded_by", "content_hash", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("chunk_count"), F.lit(None).cast("string").alias("error_message"))
    stored = documents.select("document_id", "workspace_id", "uploaded_by", "content_hash", "status", F.col("chunk_count").cast("long").alias("chunk_count"), "error_message")
    return upserted(stored, made, ["document_id"], ["uploaded_by", "content_hash"])


def reuse_patched(vectors: DataFrame, uses: DataFrame) -> DataFrame:
    """Vectors with the reuse counts that have changed (chunk_id, reuse_count)."""
    return changed(vectors, uses, ["chunk_id"], {"reuse_count": F.col("new.reuse_count")})


def touched(tenants: DataFrame, seen: DataFrame) -> DataFrame:
    """Tenants (tenant_id, status, created_at, last_activity_at) with those seen (tenant_id, at) made or touched; activity never goes back."""
    last = seen.groupBy("tenant_id").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    met = tenants.join(last, "tenant_id", "full")
    return met.select("tenant_id", F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("created_at", "first").alias("created_at"), F.greatest("last_activity_at", "last").alias("last_activity_at"))


def marked_failed(documents: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Documents that failed (workspace_id, document_id, error_message), whatever their run; other workspaces' stay as they are."""
    return changed(documents, failures, ["workspace_id", "document_id"], {"status": F.lit("failed"), "error_message": F.col("new.error_message"), "updated_at": now})


def deleted(documents: DataFrame, chunks: DataFrame, counters: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and the workspaces' counters (workspace_id, documents, chunks) without the documents ``gone`` (document_id).

    Counters fall by what was really there, to 0 at least.
    """
    hit = documents.join(gone.select("document_id").distinct(), "document_id", "left_semi")
    lost = chunks.join(gone.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    by_space = hit.join(lost, "document_id", "left").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("lost_documents"), F.sum(F.coalesce("n", F.lit(0))).alias("lost_chunks"))
    left = counters.join(by_space, "workspace_id", "left")
    fewer = lambda c: F.greatest(F.lit(0), F.col(c) - F.coalesce(f"lost_{c}", F.lit(0))).alias(c)
    return without(documents, gone, ["document_id"]), without(chunks, gone, ["document_id"]), left.select("workspace_id", fewer("documents"), fewer("chunks"))


def feedback_upserted(feedback: DataFrame, incoming: DataFrame) -> DataFrame:
    """One verdict an event (event_id, verdict, evidence, query_text, updated_at), the last; the query's text stays that of the first."""
    both = feedback.unionByName(incoming)
    firsts = both.groupBy("event_id").agg(F.min_by("query_text", F.struct("updated_at", "verdict")).alias("query_text"))
    return newest(both, ["event_id"], "updated_at", "verdict").drop("query_text").join(firsts, "event_id")


def events_inserted(events: DataFrame, incoming: DataFrame) -> DataFrame:
    """Events with those that come in; an event_id that is there already stays as it is, one that comes twice counts once."""
    from siftloom.operators.tables import appended

    return events.unionByName(appended(events, incoming, ["event_id"]))


def events_of(events: DataFrame, workspaces: Sequence[object], event_id: object = None, limit: int | None = None) -> DataFrame:
    """Evaluation events of the caller's workspaces, newest first, or the one with an id if it is one of theirs. Raises ValueError without workspaces."""
    if not workspaces:
        raise ValueError("workspaces must be named")
    rows = events.where(F.col("workspace_id").isin(list(workspaces)))
    rows = rows if event_id is None else rows.where(F.col("event_id") == F.lit(event_id))
    rows = rows.orderBy(F.col("created_at").desc(), F.col("event_id").desc())
    return rows if limit is None else rows.limit(limit)


def events_kept(events: DataFrame, now: Column, days: int) -> DataFrame:
    """Evaluation events of the last ``days``; cases that were made of older ones stay in their own table."""
    return events.where(F.col("created_at") > now.cast(events.schema["created_at"].dataType) - F.make_dt_interval(F.lit(days)))


def events_deleted(events: DataFrame, cases: DataFrame, gone: DataFrame, with_cases: bool = False) -> tuple[DataFrame, DataFrame]:
    """Evaluation events without those that are gone; their cases stay unless asked for."""
    return without(events, gone, ["event_id"]), without(cases, gone, ["event_id"]) if with_cases else cases


def case_toggled(cases: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Cases switched on or off by changes (workspace_id, case_id, active)."""
    return changed(cases, changes, ["workspace_id", "case_id"], {"active": F.col("new.active"), "updated_at": now})


def active_cases(cases: DataFrame, workspace: str, case_ids: Sequence | None = None, since: Column | None = None) -> DataFrame:
    """The workspace's active cases, oldest first: those named, and those made since a time, where they are given."""
    rows = in_scope(cases, workspace).where(F.col("active"))
    rows = rows.where(F.col("case_id").isin(list(case_ids))) if case_ids else rows
    rows = rows if since is None else rows.where(F.col("created_at") >= since)
    return rows.orderBy("created_at", "case_id")


def runs_finished(runs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Running evaluation runs with results become finished, with the means of their results by mode as JSON; the others stay.

    results: run_id, mode, recall, mrr, ndcg.
    """
    means = results.groupBy("run_id", "mode").agg(*(F.round(F.avg(m), 6).alias(m) for m in ("recall", "mrr", "ndcg")))
    by_run = means.groupBy("run_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("mode", F.struct("recall", "mrr", "ndcg")))))).alias("aggregates"))
    values = {"status": F.lit("finished"), "aggregates": F.col("new.aggregates"), "finished_at": now}
    return changed(runs, by_run, ["run_id"], values, F.col("status") == "running")


def last_run(runs: DataFrame, workspace: str) -> DataFrame:
    """The workspace's run that started last."""
    return in_scope(runs, workspace).orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1)


def event_log(events: DataFrame, document_id: object = None, run_id: object = None) -> DataFrame:
    """Ingestion events of a document or a run in the order of time. Raises ValueError without either."""
    if document_id is None and run_id is None:
        raise ValueError("a document or a run must be named")
    rows = events if document_id is None else events.where(F.col("document_id") == F.lit(document_id))
    rows = rows if run_id is None else rows.where(F.col("run_id") == F.lit(run_id))
    return rows.orderBy("created_at", "event_id")


def letters_page(letters: DataFrame, workspace: str, status: str | None = "pending", limit: int = 100) -> DataFrame:
    """A workspace's dead letters newest first, with a status or all of them."""
    rows = in_scope(letters, workspace)
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.col("failed_at").desc(), "letter_id").limit(limit)


def letters_retried(letters: DataFrame, retried: DataFrame) -> DataFrame:
    """The letters named (letter_id) are tried again: one retry more, status ``retrying``."""
    values = {"retry_count": F.coalesce("retry_count", F.lit(0)) + 1, "status": F.lit("retrying")}
    return changed(letters, retried.select("letter_id").distinct(), ["letter_id"], values)


def purge_receipt(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], workspace: str) -> DataFrame:
    """Of each table how many rows of the workspace were removed and how many are left: name, removed, residue, clean."""
    found = None
    for name, table in before.items():
        counts = [in_scope(t, workspace).agg(F.count(F.lit(1)).alias(c)) for t, c in ((table, "had"), (after[name], "residue"))]
        row = counts[0].join(F.broadcast(counts[1])).select(F.lit(name).alias("name"), (F.col("had") - F.col("residue")).alias("removed"), "residue", (F.col("residue") == 0).alias("clean"))
        found = row if found is None else found.unionByName(row)
    return found


def completions(results: DataFrame) -> DataFrame:
    """The event that tells of each processed document (document_id, workspace_id, success, chunk_count, error): document_id, event_type, status and payload as JSON."""
    good = F.coalesce("success", F.lit(False))
    rows = results.withColumns({"event_type": F.when(good, "document.processed").otherwise("document.failed"), "status": F.when(good, "ready").otherwise("failed")})
    body = F.struct("event_type", "document_id", "workspace_id", good.alias("success"), "status", F.coalesce("chunk_count", F.lit(0)).alias("chunks_created"), "error")
    return rows.select("document_id", "event_type", "status", F.to_json(body).alias("payload"))


def publisher(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes events as JSON lines; a batch's path is its id, so one that is repeated is sent once."""

    def publish(events: DataFrame, batch_id: int) -> None:
        events.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return publish


def reindexed(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What it takes to index documents (document_id) anew from their rows: the vectors that stay, the chunks to embed in order, and a report (document_id, chunks, skipped, reason)."""
    asked = asked.select("document_id").distinct()
    told = documents.select("document_id", F.lit(True).alias("known"))
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    reason = F.when(F.col("known").isNull(), "document not found").when(F.col("chunks").isNull(), "no chunks stored")
    report = asked.join(told, "document_id", "left").join(counts, "document_id", "left").select("document_id", F.when(F.col("known"), F.coalesce("chunks", F.lit(0))).otherwise(0).cast("long").alias("chunks"), reason.isNotNull().alias("skipped"), reason.alias("reason"))
    due = report.where("not skipped").select("document_id")
    todo = chunks.join(due, "document_id", "left_semi").repartition("document_id").sortWithinPartitions("document_id", "chunk_index")
    return without(vectors, due, ["document_id"]), todo, report
