"""Queries over rows: statistics, lifecycle and limits. Orders, customers and events stand for documents, tenants and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions import text as fn
from siftloom.operators import stats, tables
from siftloom.plans.registry import Tables, query
from siftloom.streaming import limits

NOW = "2024-02-01 00:00:00"


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount - 0.05 > 0 THEN l_discount - 0.05 WHEN l_tax - 0.04 > 0 THEN l_tax - 0.04 WHEN l_quantity - 10 > 0 THEN greatest(0, 1 - (l_quantity - 10) / 20 / 2) ELSE 0 END, 6) AS score,
round((1 + l_discount) / 2, 6) AS certainty, round(CASE WHEN l_linenumber > 1 THEN least(1.5, 1 + 0.2::DOUBLE * ln(1 + l_linenumber)) ELSE 1.0 + 0.2::DOUBLE * ln(2) END, 6) AS multiplier FROM lineitem""")
def score_functions(t: Tables) -> DataFrame:
    score = fn.resolve_score(F.col("l_discount") - 0.05, F.col("l_tax") - 0.04, (F.col("l_quantity") - 10) / 20)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"), F.round(fn.certainty_of(F.col("l_discount")), 6).alias("certainty"), F.round(fn.reuse_multiplier(F.col("l_linenumber"), 0.2), 6).alias("multiplier"))


@query(f"""SELECT event_id, CASE WHEN event_type = 'view' THEN false ELSE ts < TIMESTAMP '{NOW}' - INTERVAL 15 DAY END AS stale FROM events""")
def staleness(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "conversation").otherwise("document")
    return t.events.select("event_id", fn.is_stale(F.col("ts"), kind, F.lit(NOW).cast("timestamp"), 15).alias("stale"))


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def retention(t: Tables) -> DataFrame:
    return tables.retained(t.events, "ts", F.lit(NOW).cast("timestamp"), 10).select("event_id")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents)
SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS first_id, count(*) OVER (PARTITION BY content_hash) AS copies FROM h""")
def doc_exact_dedup(t: Tables) -> DataFrame:
    return tables.first_copies(t.documents)


@query("""WITH k AS (SELECT o_orderkey AS document_id, o_orderstatus AS workspace_id, 'f' || o_custkey % 300 AS filename, 'h' || o_custkey % 500 AS content_hash, o_orderdate AS created_at FROM orders),
u AS (SELECT o_orderkey AS upload_id, o_orderstatus AS workspace_id, 'f' || o_custkey * 7 % 900 AS filename, 'h' || (o_custkey * 13 + o_orderkey) % 900 AS content_hash FROM orders),
a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY workspace_id, content_hash ORDER BY created_at DESC, document_id DESC) = 1),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY workspace_id, filename ORDER BY created_at DESC, document_id DESC) = 1)
SELECT u.*, coalesce(a.document_id, b.document_id) AS document_id, CASE WHEN a.document_id IS NOT NULL THEN 'skip' WHEN b.document_id IS NOT NULL THEN 'replace' ELSE 'create' END AS decision
FROM u LEFT JOIN a ON u.workspace_id = a.workspace_id AND u.content_hash = a.content_hash LEFT JOIN b ON u.workspace_id = b.workspace_id AND u.filename = b.filename""")
def intake_decisions(t: Tables) -> DataFrame:
    """Every order is uploaded again under other names and contents."""

    def of(key: str, name: F.Column, digest: F.Column) -> DataFrame:
        tag = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
        return t.orders.select(F.col("o_orderkey").alias(key), F.col("o_orderstatus").alias("workspace_id"), tag("f", name).alias("filename"), tag("h", digest).alias("content_hash"), F.col("o_orderdate").alias("created_at"))

    c = F.col("o_custkey")
    return tables.intake(of("upload_id", c * 7 % 900, (c * 13 + F.col("o_orderkey")) % 900).drop("created_at"), of("document_id", c % 300, c % 500))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return tables.newest(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_newest(t: Tables) -> DataFrame:
    return tables.page(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 100, 50)


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS in_flight FROM orders")
def quota_counts(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("o_orderstatus").isin("O", "P"), 1)).alias("in_flight"))


@query("""WITH c AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS owner FROM orders), i AS (SELECT o_orderkey + 4000 AS k, 'pending' AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'new' END AS owner FROM orders)
SELECT coalesce(c.k, i.k) AS k, CASE WHEN i.k IS NOT NULL THEN i.status ELSE c.status END AS status, coalesce(i.owner, c.owner) AS owner FROM c FULL JOIN i ON c.k = i.k""")
def upsert_rows(t: Tables) -> DataFrame:
    """Every order comes in under a later key, so some replace stored rows and some are new."""
    current = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("owner"))
    incoming = t.orders.select((F.col("o_orderkey") + 4000).alias("k"), F.lit("pending").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "new").alias("owner"))
    return tables.upserted(current, incoming, ["k"], ["owner"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
def append_new_rows(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    return tables.appended(t.lineitem.where("l_returnflag = 'A'"), t.lineitem, keys).select(*keys)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.without(t.lineitem.select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def index_orphans_anti(t: Tables) -> DataFrame:
    return tables.orphans(t.documents.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""WITH c AS (SELECT o_custkey AS document_id, o_orderkey AS run_id, o_orderdate AS claimed_at FROM orders WHERE o_custkey % 5 > 0), h AS (SELECT document_id, arg_max(run_id, (claimed_at, run_id)) AS holder FROM c GROUP BY 1)
SELECT o_custkey AS document_id, o_orderkey AS run_id FROM orders LEFT JOIN h ON document_id = o_custkey WHERE holder IS NULL OR holder = o_orderkey""")
def run_fencing(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("claimed_at"))
    return tables.fenced(runs.where("document_id % 5 > 0"), runs.select("document_id", "run_id"))


@query("""WITH l AS (SELECT event_id AS letter_id, user_id % 50 AS document_id, CASE WHEN event_id % 10 > 0 THEN event_id % 7 END AS run_id, event_type AS dedup_key, ts AS failed_at, ['pending', 'retrying', 'failed'][1 + event_id % 3] AS status FROM events WHERE event_type = 'error'),
k AS (SELECT * FROM l WHERE run_id IS NULL UNION ALL (SELECT * FROM l WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, run_id, dedup_key ORDER BY failed_at DESC, letter_id DESC) = 1))
SELECT letter_id, document_id, CASE WHEN document_id % 2 = 0 AND status IN ('pending', 'retrying') THEN 'resolved' ELSE status END AS status FROM k""")
def dead_letters(t: Tables) -> DataFrame:
    letters = t.events.where("event_type = 'error'").select(
        F.col("event_id").alias("letter_id"), (F.col("user_id") % 50).alias("document_id"), F.when(F.col("event_id") % 10 > 0, F.col("event_id") % 7).alias("run_id"), F.col("event_type").alias("dedup_key"), F.col("ts").alias("failed_at"),
        F.element_at(F.array(*map(F.lit, ("pending", "retrying", "failed"))), (F.col("event_id") % 3 + 1).cast("int")).alias("status"),
    )
    done = t.events.select((F.col("user_id") % 50).alias("document_id")).where("document_id % 2 = 0")
    return tables.resolved(tables.dead_letters(letters), done).select("letter_id", "document_id", "status")


@query("""SELECT event_id // 3 AS audit_id, min(event_id) AS event_id FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL GROUP BY 1""")
def audit_dedup(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.floor(F.col("event_id") / 3).alias("audit_id"), F.col("event_type").alias("source"), "value")
    return tables.audit_log(rows, ["audit_id", "value"], ["view", "click"], "event_id").select("audit_id", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-01-01' AND (l_returnflag = 'N' OR l_shipdate + INTERVAL 90 DAY > TIMESTAMP '1997-01-01')")
def as_of_version(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumns({"valid_from": F.col("l_shipdate"), "valid_until": F.when(F.col("l_returnflag") != "N", F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS"))})
    return tables.as_of(rows, F.lit("1997-01-01").cast("timestamp")).select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderpriority AS workspace, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p,
round(sum(CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE o_totalprice END), 2) AS total, round(avg(CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE o_totalprice END), 4) AS mean, round(coalesce(avg(CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_totalprice END), 0), 4) AS mean_known FROM orders GROUP BY 1""")
def workspace_stats(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("o_totalprice", F.when(F.col("o_custkey") % 10 != 0, F.col("o_totalprice"))).withColumnRenamed("o_orderpriority", "workspace")
    return stats.status_stats(rows, ["workspace"], "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS workspaces, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def tenant_stats(t: Tables) -> DataFrame:
    return stats.tenant_stats(t.orders, "o_custkey", "o_orderpriority", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def tenant_summary(t: Tables) -> DataFrame:
    return stats.tenant_summary(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_totalprice")


@query("SELECT source AS workspace, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def documents_per_workspace(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("workspace")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents WHERE source = 'src1' UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus = 'X' UNION ALL SELECT 'events', count(*) FROM events WHERE event_type = 'error'")
def residue_counts(t: Tables) -> DataFrame:
    return stats.residue({"documents": t.documents.where("source = 'src1'"), "orders": t.orders.where("o_orderstatus = 'X'"), "events": t.events.where("event_type = 'error'")})


@query("""WITH r AS (SELECT o_custkey % 10 AS user_id, ['low', 'medium', 'high', 'odd', NULL][1 + o_orderkey % 5] AS risk FROM orders)
SELECT user_id, count(*) FILTER (risk IS NULL OR risk NOT IN ('low', 'medium', 'high')) AS none, count(*) FILTER (risk = 'low') AS low, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk = 'high') AS high FROM r GROUP BY 1""")
def risk_tally(t: Tables) -> DataFrame:
    risk = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "odd", None))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return stats.risk_tally(t.orders.select((F.col("o_custkey") % 10).alias("user_id"), risk.alias("risk")), "user_id", "risk")


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(t: Tables) -> DataFrame:
    return stats.percentiles(t.events, "event_type", "value")


@query("""WITH s AS (SELECT user_id, event_id // 2 AS run, arg_min(event_id % 7 - 3, event_id) AS delta, min(event_id) AS began FROM events GROUP BY 1, 2), w AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY began, run) AS walk FROM s)
SELECT user_id, (sum(delta) - least(0, min(walk)))::BIGINT AS value FROM w GROUP BY 1""")
def floored_counters(t: Tables) -> DataFrame:
    steps = t.events.select("user_id", F.floor(F.col("event_id") / 2).alias("run"), "event_id", (F.col("event_id") % 7 - 3).alias("delta"))
    return stats.floored_counters(steps, "user_id", "run", "event_id", "delta")


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS hits, greatest(0, count(*) - 2) AS rejected FROM events GROUP BY 1, 2")
def rate_limit_fixed_window(t: Tables) -> DataFrame:
    return limits.fixed_windows(t.events, "user_id", "ts", 2, 3600)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, event_id, n, sec, 2.0::DOUBLE AS before FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.event_id, e.n, e.sec, least(2.0::DOUBLE, b.before - CASE WHEN b.before >= 1 THEN 1 ELSE 0 END + (e.sec - b.sec) * (2 / 3600::DOUBLE)) FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT event_id, before >= 1 AS allowed FROM b""")
def rate_limit_token_bucket(t: Tables) -> DataFrame:
    return limits.token_bucket(t.events, "user_id", "ts", 2, 3600).select("event_id", "allowed")


@query("SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def accessible_ids(t: Tables) -> DataFrame:
    owned, member = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id"))
    return owned.union(member).distinct().subtract(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("""SELECT o_custkey, max(CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 2 END)::INT AS best FROM orders GROUP BY 1""")
def best_role(t: Tables) -> DataFrame:
    role = F.when(F.col("o_orderstatus") == "F", "owner").when(F.col("o_orderstatus") == "O", "member").otherwise("guest")
    return t.orders.groupBy("o_custkey").agg(F.max(fn.role_rank(role)).alias("best"))
