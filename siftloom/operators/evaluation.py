"""Ranking metrics, the regression gate and evaluation records."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(ranked: DataFrame) -> DataFrame:
    """Each id's first place in a query's list (query_id, id, rank), later ones removed and ranks closed up."""
    first = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))


def metrics(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """For each judged query recall, ndcg and hit at k and the reciprocal rank (without a cut).

    judged: query_id, id, grade; grades above 0 are relevant. Queries without
    relevant ids have 0 everywhere; k of 0 or less gives 0 at k.
    """
    k = max(k, 0)
    graded = judged.groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "id"))
    ideal = graded.where("grade > 0").withColumn("place", place)
    wanted = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1))).alias("ideal"))
    hits = deduplicated(ranked).join(graded.where("grade > 0"), ["query_id", "id"])
    near = F.col("rank") <= k
    found = hits.groupBy("query_id").agg(F.count(F.when(near, 1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(near, gain / F.log2(F.col("rank") + 1))).alias("dcg"))
    every = judged.select("query_id").distinct().join(wanted, "query_id", "left").join(found, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return every.select(
        "query_id",
        zero(F.col("hits") / F.col("relevant")).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal"))).alias("ndcg"),
        zero(F.when(F.col("hits") > 0, 1.0)).alias("hit"),
    )


def means(per_query: DataFrame, by: str = "mode") -> DataFrame:
    return per_query.groupBy(by).agg(*(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in ("recall", "mrr", "ndcg", "hit")))


#: The most that one query can move a mean of each metric by changing a rank.
STEPS = {"mrr": 0.5, "recall": 1.0, "ndcg": 1 - 1 / log2(3)}


def tolerance(metric: Column, n: Column) -> Column:
    step = F.coalesce(*(F.when(metric == m, F.lit(s)) for m, s in STEPS.items()), F.lit(1.0))
    return F.greatest(F.lit(0.02), step / n)


def gate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline (mode, metric, value) against current (mode, metric, value, n): delta, allowed, regressed, and the ratcheted baseline.

    Only what the baseline has is judged. A metric that the current run lacks
    counts as 0, with the largest ``n`` of the run for its tolerance.
    """
    both = baseline.withColumnRenamed("value", "base").join(current, ["mode", "metric"], "left").join(F.broadcast(current.agg(F.max("n").alias("n_run"))))  # one row
    allowed = tolerance(F.col("metric"), F.coalesce("n", "n_run", F.lit(1)))
    now = F.coalesce("value", F.lit(0.0))
    return both.select(
        "mode", "metric", "base", "value", F.round(now - F.col("base"), 6).alias("delta"), F.round(allowed, 6).alias("allowed"),
        (now < F.col("base") - allowed).alias("regressed"), F.greatest("base", "value").alias("ratchet"),
    )


def ratcheted(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """The baseline that never falls: mode, metric, value, the greater one of both sides, with what only one of them has."""
    both = baseline.select("mode", "metric", F.col("value").alias("base")).join(current.select("mode", "metric", "value"), ["mode", "metric"], "full")
    return both.select("mode", "metric", F.greatest("base", "value").alias("value"))


def latest(rows: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The last row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), *(F.col(t).desc() for t in ties))
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def promoted(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Cases from feedback: answered gives grade 2, partial with evidence 1; expected documents are those of the evidence, without evidence all, each once in order.

    events: event_id, document_ids, chunk_ids (arrays side by side); feedback:
    event_id, verdict, evidence (chunk ids). Evidence that names no chunk of the
    event, and events without documents, give no case.
    """
    met = feedback.join(events, "event_id")
    named = F.coalesce(F.size("evidence"), F.lit(-1)) > 0
    grade = F.when(F.col("verdict") == "answered", 2).when((F.col("verdict") == "partial") & named, 1)
    pairs = F.arrays_zip(F.col("document_ids").alias("d"), F.col("chunk_ids").alias("c"))
    told = F.transform(F.filter(pairs, lambda p: F.array_contains(F.col("evidence"), p["c"])), lambda p: p["d"])
    expected = F.array_distinct(F.when(named, told).otherwise(F.col("document_ids")))
    cases = met.select("event_id", grade.alias("grade"), expected.alias("expected"))
    return cases.where("grade is not null and size(expected) > 0")


def merged_cases(cases: DataFrame) -> DataFrame:
    """One case for each (workspace_id, query): all expected ids once, sorted, and the highest grade."""
    key = F.md5(F.lower("query").cast("binary"))
    keyed = cases.withColumn("case_key", key)
    found = keyed.groupBy("workspace_id", "case_key").agg(F.min("query").alias("query"), F.max("grade").alias("grade"))
    # each id once before ids meet, so a case that is told very often is no large group
    ids = keyed.select("workspace_id", "case_key", F.explode("expected").alias("id")).distinct()
    ids = ids.groupBy("workspace_id", "case_key").agg(F.sort_array(F.collect_list("id")).alias("expected"))
    none = F.array().cast(cases.schema["expected"].dataType)
    return found.join(ids, ["workspace_id", "case_key"], "left").select("workspace_id", "case_key", "query", F.coalesce("expected", none).alias("expected"), "grade")


#: The kinds of feedback that count as an answer.
POSITIVE = ("answered", "partial")
#: Days that a scorecard looks back, and labelled cases below which its rates are of low confidence.
WINDOW_DAYS, MIN_CASES = 30, 50


def distribution(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """A map from each value that is not null to its number, a row for each ``by``."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n")))).alias(name))


def scorecard(events: DataFrame, feedback: DataFrame, by: str = "workspace_id") -> DataFrame:
    """Captured events, feedback, their distributions, and rates: feedback over captured (0 without), answered or partial over feedback (null without).

    events: by, quality_verdict; feedback: by, verdict. Groups that either side has.
    """
    captured = events.groupBy(by).agg(F.count(F.lit(1)).alias("captured"))
    said = feedback.groupBy(by).agg(F.count(F.lit(1)).alias("feedback"), F.count(F.when(F.col("verdict").isin(*POSITIVE), 1)).alias("positive"))
    both = captured.join(said, by, "full").fillna(0, ["captured", "feedback", "positive"])
    both = both.join(distribution(events, by, "quality_verdict", "verdict_distribution"), by, "left").join(distribution(feedback, by, "verdict", "feedback_distribution"), by, "left")
    none = F.create_map().cast("map<string,bigint>")
    return both.select(
        by,
        "captured",
        "feedback",
        F.when(F.col("captured") > 0, F.round(F.col("feedback") / F.col("captured"), 6)).otherwise(0.0).alias("feedback_rate"),
        F.when(F.col("feedback") > 0, F.round(F.col("positive") / F.col("feedback"), 6)).alias("answer_rate"),
        F.coalesce("verdict_distribution", none).alias("verdict_distribution"),
        F.coalesce("feedback_distribution", none).alias("feedback_distribution"),
    )


def replay_metrics(cases: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Metrics of every mode over active cases (query_id, id, grade): results have mode too; a mode that found nothing counts as zeros."""
    from siftloom.operators.search import sized

    modes = results.select("mode").distinct()
    judged = cases.join(sized(modes)).withColumn("query_id", F.struct("mode", "query_id"))
    ranked = results.withColumn("query_id", F.struct("mode", "query_id"))
    per = metrics(ranked, judged, k).select(F.col("query_id.mode").alias("mode"), F.col("query_id.query_id").alias("query_id"), "recall", "mrr", "ndcg", "hit")
    return means(per)


def corpus_gaps(feedback: DataFrame, by: str = "workspace_id", n: int = 5) -> DataFrame:
    """The texts of the last queries whose results were not relevant: by, gaps (newest first, n at most)."""
    order = Window.partitionBy(by).orderBy(F.col("created_at").desc(), F.col("event_id").desc())
    last = feedback.where("verdict = 'not_relevant'").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    return last.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "query_text"))), lambda x: x["query_text"]).alias("gaps"))


def full_scorecard(
    events: DataFrame, feedback: DataFrame, cases: DataFrame, runs: DataFrame, now: Column, by: str = "workspace_id", days: int = WINDOW_DAYS, least: int = MIN_CASES
) -> DataFrame:
    """The scorecard of the last ``days`` with active cases, gaps, the last run and a summary; low_confidence: fewer than ``least`` active cases.

    events and feedback have created_at; cases: by, active; runs: by, run_id,
    status, started_at and whatever a run holds, the last of which is the struct
    last_run (null without). Events and feedback older than the window don't
    count; gaps, cases and runs are of any time. Groups that any side but the
    runs has.
    """

    def recent(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("created_at") > now - F.make_dt_interval(F.lit(days)))

    active = cases.where("active").groupBy(by).agg(F.count(F.lit(1)).alias("eval_case_count"))
    rest = [c for c in runs.columns if c != by]
    last = runs.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct("started_at", "run_id")).alias("last_run"))
    both = scorecard(recent(events), recent(feedback), by).join(active, by, "full").join(corpus_gaps(feedback, by), by, "full").join(last, by, "left")
    none = F.create_map().cast("map<string,bigint>")
    both = both.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in ("captured", "feedback", "feedback_rate", "eval_case_count")},
        **{c: F.coalesce(c, none) for c in ("verdict_distribution", "feedback_distribution")},
        "gaps": F.coalesce("gaps", F.array().cast("array<string>")),
    }).withColumn("low_confidence", F.col("eval_case_count") < least)
    return both.withColumn("summary", _summary(days, least))


def _summary(days: int, least: int) -> Column:
    """What the scorecard says, in words."""

    def percent(rate: str) -> Column:
        return F.concat(F.round(100 * F.col(rate)).cast("long").cast("string"), F.lit("%"))

    feedback = F.when(
        F.col("answer_rate").isNotNull(),
        F.concat(F.lit(" "), F.col("feedback").cast("string"), F.lit(" of them have feedback ("), percent("feedback_rate"), F.lit("); "), percent("answer_rate"), F.lit(" of that is answered in full or in part.")),
    ).otherwise("")
    few = F.when(F.col("low_confidence"), f" With fewer than {least} cases all rates are of low confidence.").otherwise("")
    gaps = F.when(F.size("gaps") > 0, F.concat(F.lit(" Queries without relevant results: "), F.array_join("gaps", ", "), F.lit("."))).otherwise("")
    said = F.concat(F.col("captured").cast("string"), F.lit(f" searches captured in {days} days."), feedback, F.lit(" "), F.col("eval_case_count").cast("string"), F.lit(" labelled cases."), few, gaps)
    return F.when((F.col("captured") == 0) & (F.col("eval_case_count") == 0), "No searches captured and no labelled cases.").otherwise(said)


def dataset_eval(results: DataFrame, expected: DataFrame, k: int, min_hit_rate: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Results (query_id, document_id, chunk_id, pos) against expected ids (query_id, id) of documents or chunks.

    Gives a row a query (query_id, hit, mrr, returned) and one of all (queries,
    hit_rate, mrr, passed): passed unless the hit rate is below the least one.
    """
    wanted = expected.groupBy("query_id").agg(F.collect_set(F.col("id").cast("string")).alias("ids"))
    rows = results.select("query_id", "pos", F.col("document_id").cast("string").alias("d"), F.col("chunk_id").cast("string").alias("c")).join(wanted, "query_id")
    # a result stands for its document if that is expected, else for its chunk
    ranked = rows.select("query_id", F.col("pos").alias("rank"), F.when(F.array_contains("ids", F.col("d")), F.col("d")).otherwise(F.col("c")).alias("id"))
    judged = expected.select("query_id", F.col("id").cast("string").alias("id"), F.lit(1).alias("grade"))
    told = metrics(ranked.where("id is not null"), judged, k).select("query_id", "hit", "mrr")
    each = told.join(results.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned")), "query_id", "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    rate = F.round(F.coalesce(F.avg("hit"), F.lit(0.0)), 6)
    total = each.agg(F.count(F.lit(1)).alias("queries"), rate.alias("hit_rate"), F.round(F.coalesce(F.avg("mrr"), F.lit(0.0)), 6).alias("mrr"))
    return each, total.withColumn("passed", F.col("hit_rate") >= min_hit_rate)


def captured(queries: DataFrame, results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """An evaluation event a query: event_id, query_text (cut short), document_ids, chunk_ids (side by side, best first), top_score, quality_verdict.

    queries: event_id, query_id, query; verdicts: query_id, top_score, verdict.
    """
    from siftloom.functions.text import recorded_query

    lists = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "document_id", "chunk_id"))).alias("x"))
    met = queries.join(lists, "query_id", "left").join(verdicts.select("query_id", "top_score", "verdict"), "query_id", "left")
    of = lambda c: F.coalesce(F.col(f"x.{c}"), F.array().cast(f"array<{results.schema[c].dataType.simpleString()}>"))
    return met.select("event_id", recorded_query("query").alias("query_text"), of("document_id").alias("document_ids"), of("chunk_id").alias("chunk_ids"), "top_score", F.col("verdict").alias("quality_verdict"))
