"""Rate limits over events, and a queue read from files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.operators import scans
from siftloom.session import ship, written


def fixed_windows(events: DataFrame, key: str, at: str, limit: int, seconds: int = 60) -> DataFrame:
    """Hits of each key in windows of ``seconds`` from the epoch: key, window_start, hits, rejected. Works on streams with a watermark too."""
    counts = events.groupBy(key, F.window(at, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("hits"))
    return counts.select(key, F.col("w.start").alias("window_start"), "hits", F.greatest(F.lit(0), F.col("hits") - limit).alias("rejected"))


def walked(rows: DataFrame, key: str, order: Sequence[str], schema: T.StructType, begin: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Each key's rows in order through ``step(state, rows)``, a batch at a time: a key of any size takes one state and one batch of memory.

    A key's rows are walked by one task, as each depends on those before.
    """
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            for _, part in frame.groupby((frame[key] != frame[key].shift()).cumsum(), sort=False):
                own = part[key].iloc[0]
                if state is None or own != now:
                    now, state = own, begin()
                yield step(state, part)

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _seconds(times: pd.Series) -> Any:
    return times.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


def token_bucket(events: DataFrame, key: str, at: str, limit: int, seconds: int = 60) -> DataFrame:
    """Each event with ``allowed``: a bucket of ``limit`` tokens a key, refilled at limit / seconds; events of one time in the order of ``event_id``. Events without a key are left out."""
    rows = events.select(key, at, "event_id")
    rate = limit / seconds

    def step(state: dict[str, Any], part: pd.DataFrame) -> pd.DataFrame:
        allowed = []
        for now in _seconds(part[at]):
            tokens = min(limit, state["tokens"] + (0 if state["last"] is None else now - state["last"]) * rate)
            allowed.append(tokens >= 1)
            state.update(tokens=tokens - (tokens >= 1), last=now)
        return part.assign(allowed=allowed)

    return walked(rows, key, [at, "event_id"], rows.schema.add("allowed", "boolean"), lambda: {"tokens": float(limit), "last": None}, step)


def window_openers(moments: DataFrame, key: str, micros: int) -> DataFrame:
    """The moments (key, t; each once) that open a window: a key's first, and the first at or after the end of each window before.

    Each moment is linked to the first one at or after its window's end. From a
    key's first moment the openers are those that the links reach: with links of
    1, 2, 4 ... steps each round doubles how many are known, so a key of any
    number of windows takes a logarithm of rounds of joins, not one task's walk.
    """
    # backwards in time a moment comes before the ends that it is at or after
    hits = moments.select(key, F.col("t").alias("of"), (-F.col("t")).alias("back"), F.lit(0).alias("end"), (-F.col("t")).alias("hit"))
    ends = moments.select(key, F.col("t").alias("of"), (-F.col("t") - micros).alias("back"), F.lit(1).alias("end"), F.lit(None).cast("long").alias("hit"))
    order = ["back", "end"]
    met = scans.greatest_before(scans.ranged(hits.unionByName(ends), [key], order), [key], order, "hit", "next")
    jump = written(met.where("end = 1 and next is not null").select(key, F.col("of").alias("t"), (-F.col("next")).alias("to")), "links")
    found = written(moments.groupBy(key).agg(F.min("t").alias("t")), "openers")
    while jump.limit(1).count():
        more = found.join(jump, [key, "t"]).select(key, F.col("to").alias("t"))
        found = written(found.unionByName(more), "openers")  # the openers known so far and as many after them
        far = jump.select(key, "t", F.col("to").alias("mid")).join(jump.select(key, F.col("t").alias("mid"), "to"), [key, "mid"])
        jump = written(far.select(key, "t", "to"), "links")
    return found


def first_hit_windows(events: DataFrame, key: str, at: str, limit: int, seconds: int = 60) -> DataFrame:
    """Each event with the window that it falls in and whether it is allowed: window_start, nth, allowed.

    A key's window opens at its first hit and lasts ``seconds`` whatever comes
    in; the first hit at its end or later opens the next. Events of one time go
    in the order of ``event_id``; those without a key or time are left out.
    """
    kind = events.schema[at].dataType
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, "event_id").withColumn("t", F.unix_micros(F.col(at).cast("timestamp")))
    rows = written(rows, "hits")
    openers = window_openers(rows.select(key, "t").distinct(), key, int(seconds * 1_000_000))
    # an opener comes before the hits of its own moment
    both = rows.select(key, "t", F.lit(1).alias("hit"), F.col(at).alias("shown"), "event_id", F.lit(None).cast("long").alias("opens"))
    marks = openers.select(key, "t", F.lit(0).alias("hit"), F.lit(None).cast(kind).alias("shown"), F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.col("t").alias("opens"))
    order = ["t", "hit", "event_id"]
    placed = scans.greatest_before(scans.ranged(both.unionByName(marks), [key], order), [key], order, "opens", "window").where("hit = 1")
    counted = scans.running_sum(scans.ranged(placed.drop("_range"), [key, "window"], ["t", "event_id"]), [key, "window"], ["t", "event_id"], F.lit(1), "nth")
    start = F.timestamp_micros("window").cast(kind)
    nth = F.col("nth").cast("long")
    return counted.select(key, F.col("shown").alias(at), "event_id", start.alias("window_start"), nth.alias("nth"), (nth <= limit).alias("allowed"))



def file_queue(spark: SparkSession, path: str, schema: str, per_trigger: int = 10) -> DataFrame:
    """A queue as a folder of JSON files, at most ``per_trigger`` files at a time; the checkpoint is the acknowledgement."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def history(messages: DataFrame, topic: str) -> DataFrame:
    """What was sent under a topic, in order (message_id, topic, sent_at, ...)."""
    return messages.where(F.col("topic") == topic).orderBy("sent_at", "message_id")


def delivered(messages: DataFrame, max_deliveries: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pending messages (message_id, topic, deliveries, idle_ms, ...) split into those to hand out again, with one delivery more, and poison.

    Poison has been delivered ``max_deliveries`` times and is dropped for good.
    """
    due = F.coalesce("deliveries", F.lit(0)) < max_deliveries
    return messages.where(due).withColumn("deliveries", F.coalesce("deliveries", F.lit(0)) + 1), messages.where(~due)


def reclaimed(pending: DataFrame, min_idle_ms: int, max_deliveries: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a consumer takes over from others that left messages idle: (again, poison, still waiting)."""
    idle = F.coalesce(F.col("idle_ms") >= min_idle_ms, F.lit(False))
    again, poison = delivered(pending.where(idle), max_deliveries)
    return again, poison, pending.where(~idle)


def consumer(handle: Callable[[DataFrame], DataFrame], letters: str, max_deliveries: int = 5) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over messages (message_id, deliveries, ...): ``handle`` gives the ids that it took; poison goes to ``letters``.

    The batch counts as read once all is written; one that fails is read again
    from the checkpoint, and its path is its id.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, poison = delivered(batch, max_deliveries)
            done = handle(good).select("message_id").distinct()
            failed = good.join(done, "message_id", "left_anti").withColumn("reason", F.lit("failed"))
            failed.unionByName(poison.withColumn("reason", F.lit("poison"))).write.mode("overwrite").parquet(f"{letters}/batch={batch_id}")
        finally:
            batch.unpersist()

    return take
