"""Quality checks, workspace and tenant statistics, tallies and counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.operators import scans
from siftloom.operators.search import sized

RISKS = ("none", "low", "medium", "high")


def text_checks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: is_empty, too_short (under 10 stripped characters), mostly_blank (under 0.3 non-blank), has_nul, passed."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(t, r"(?U)\s+", "")
    stripped = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(stripped) == 0).alias("is_empty"),
        (F.length(stripped) < 10).alias("too_short"),
        ((F.length(t) > 0) & (F.length(bare) < 0.3 * F.length(t))).alias("mostly_blank"),
        t.contains("\x00").alias("has_nul"),
    )
    return rows.withColumn("passed", ~(F.col("is_empty") | F.col("too_short") | F.col("mostly_blank") | F.col("has_nul")))


def chunk_checks(chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per document of ``lengths`` (doc_id, n_chars): n_chunks, empty, long (above 50 000), short (under 5), gaps (indices do not run from 0), coverage."""
    n = F.length("content")
    found = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count(F.when(F.length(F.trim("content")) == 0, 1)).alias("empty"),
        F.count(F.when(n > 50_000, 1)).alias("long"),
        F.count(F.when(n < 5, 1)).alias("short"),
        ((F.min("chunk_index") != 0) | (F.max("chunk_index") != F.count(F.lit(1)) - 1) | (F.count_distinct("chunk_index") != F.count(F.lit(1)))).alias("gaps"),
        F.sum(n).alias("chars"),
    )
    joined = lengths.select("doc_id", "n_chars").join(found, "doc_id", "left")
    return joined.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "empty", "long", "short")), F.coalesce("gaps", F.lit(False)).alias("gaps"), F.round(F.when(F.col("n_chars") > 0, F.coalesce("chars", F.lit(0)) / F.col("n_chars")), 6).alias("coverage"))


def status_stats(rows: DataFrame, by: Sequence[str], status: str, statuses: Sequence[str], measure: str) -> DataFrame:
    """Per group: n, one count for each status, sum and mean of the measure (nulls as 0), and the mean over non-null values (0 without)."""
    m = F.coalesce(F.col(measure), F.lit(0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count(F.when(F.col(status) == s, 1)).alias(f"n_{s.lower()}") for s in statuses),
        F.round(F.sum(m), 2).alias("total"),
        F.round(F.avg(m), 4).alias("mean"),
        F.round(F.coalesce(F.avg(measure), F.lit(0.0)), 4).alias("mean_known"),
    )


def tenant_stats(rows: DataFrame, tenant: str, workspace: str, measure: str) -> DataFrame:
    """Per tenant: documents, distinct workspaces and the sum of the measure."""
    return rows.groupBy(tenant).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(workspace).alias("workspaces"), F.round(F.sum(F.coalesce(measure, F.lit(0))), 2).alias("total"))


def tenant_summary(tenants: DataFrame, rows: DataFrame, key: str, measure: str) -> DataFrame:
    """Every tenant with its number of rows and sum; 0 without rows. Rows are summed before they meet tenants."""
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"))
    return tenants.join(sums, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "total": F.round(F.coalesce("total", F.lit(0.0)), 2)})


def residue(tables: Mapping[str, DataFrame]) -> DataFrame:
    """How many rows each table still has: name, n."""
    counts = [t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def risk_tally(rows: DataFrame, by: str, risk: str) -> DataFrame:
    """Per group how many rows have each risk; null and unknown ones count as none."""
    known = F.when(F.col(risk).isin(*RISKS), F.col(risk)).otherwise("none")
    return rows.groupBy(by).agg(*(F.count(F.when(known == r, 1)).alias(r) for r in RISKS))


def merged_counts(rows: DataFrame, by: str, counts: str) -> DataFrame:
    """The maps of counts of each group added up: by, kind, n."""
    return rows.select(by, F.explode(counts).alias("kind", "n")).groupBy(by, "kind").agg(F.sum("n").alias("n"))


#: Accuracy of the sketch that brackets a percentile: rows between the brackets are about this part of a group.
SKETCH = 10_000


def percentiles(rows: DataFrame, by: str, measure: str, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated percentiles of each group: by, n, and one column a share; null without values.

    A sketch of each group brackets every percentile; rows below a bracket are
    counted, and only the few within are sorted, so no task holds a group.
    """
    names, margin = [f"p{round(100 * p)}" for p in shares], 4 / SKETCH
    values = rows.select(F.col(by).alias("_by"), F.col(measure).cast("double").alias("v"))
    wide = [max(p - margin, 0.0) for p in shares] + [min(p + margin, 1.0) for p in shares]
    told = values.groupBy("_by").agg(F.count("v").alias("n"), F.percentile_approx("v", wide, SKETCH).alias("q"), F.min("v").alias("least"), F.max("v").alias("most"))
    told = sized(told)  # a row a group; Spark reuses its exchange
    # brackets reach the ends where the margin does, and in small groups, all of which are sorted
    small = F.col("n") < SKETCH
    low = lambda i: F.when(small | (shares[i] - margin <= 0), F.col("least")).otherwise(F.col("q")[i])
    high = lambda i: F.when(small | (shares[i] + margin >= 1), F.col("most")).otherwise(F.col("q")[len(shares) + i])
    marked = values.where("v is not null").alias("r").join(told.alias("t"), F.col("r._by").eqNullSafe(F.col("t._by"))).select(
        F.col("r._by").alias("_by"), "v", F.array(*(F.struct(F.lit(i).alias("i"), low(i).alias("low"), high(i).alias("high")) for i in range(len(shares)))).alias("x")
    )
    each = marked.select("_by", "v", F.explode(F.filter("x", lambda b: F.col("v") <= b["high"])).alias("b"))
    below = F.count(F.when(F.col("v") < F.col("b.low"), 1))
    near = each.groupBy("_by", F.col("b.i").alias("i"), F.when(F.col("v") >= F.col("b.low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"), below.alias("below"))
    order = Window.partitionBy("_by", "i").orderBy(F.col("v").asc_nulls_first())
    upto = near.withColumn("upto", F.sum("c").over(order)).where("v is not null")
    back = upto.alias("u").join(told.select("_by", "n").alias("t"), F.col("u._by").eqNullSafe(F.col("t._by"))).select(F.col("u._by").alias("_by"), "i", "v", "upto", "n")
    rank = F.element_at(F.array(*map(F.lit, map(float, shares))), F.col("i") + 1) * (F.col("n") - 1)
    found = back.withColumn("rank", rank).groupBy("_by", "i").agg(
        F.min(F.when(F.col("upto") > F.floor("rank"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("v"))).alias("b"), F.max("rank").alias("rank")
    )
    part = F.col("rank") - F.floor("rank")
    found = found.withColumn("p", F.round((1 - part) * F.col("a") + part * F.col("b"), 6)).groupBy("_by").pivot("i", list(range(len(shares)))).agg(F.first("p"))
    met = told.select("_by", "n").alias("t").join(found.alias("f"), F.col("t._by").eqNullSafe(F.col("f._by")), "left")
    return met.select(F.col("t._by").alias(by), "n", *(F.col(f"f.{i}").alias(name) for i, name in enumerate(names)))


def throughput(rows: DataFrame, by: str, at: str) -> DataFrame:
    """Of each group its rows, the seconds from the first to the last, and rows a second (null within one moment): by, n, seconds, per_second."""
    span = (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / 1e6
    told = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), span.alias("seconds"))
    return told.select(by, "n", F.round("seconds", 3).alias("seconds"), F.when(F.col("seconds") > 0, F.round(F.col("n") / F.col("seconds"), 6)).alias("per_second"))


def floored_counters(steps: DataFrame, key: str, run: str, order: str, delta: str) -> DataFrame:
    """Counters that never fall below 0, each run applied once in order: key, value.

    A key's steps are cut into ranges, so that one with very many is no single task.
    """
    once = steps.groupBy(key, run).agg(F.min_by(delta, order).alias("delta"), F.min(order).alias("at"))
    return scans.floored_sum(once, [key], ["at", run], "delta", "value")


def total_tokens(results: DataFrame, context: DataFrame, by: str = "query_id") -> DataFrame:
    """Tokens of the context chunks of each query; results themselves carry no token counts and add 0."""
    return results.select(by).distinct().join(context.groupBy(by).agg(F.sum("token_count").alias("tokens")), by, "left").select(by, F.coalesce("tokens", F.lit(0)).alias("tokens"))
