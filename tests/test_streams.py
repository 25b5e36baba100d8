"""The keyed-state stream, really started: by size, time, close and idleness, with restarts from its checkpoint."""

import datetime as dt
import time

from siftloom.session import shared_folder
from siftloom.streaming import turn_state

SCHEMA = "conv_id long, turn_id string, text string, at timestamp, closed boolean"
BASE = dt.datetime(2024, 1, 1)


def put(spark, folder, rows):
    data = [(c, i, t, BASE + dt.timedelta(seconds=s), closed) for c, i, t, s, closed in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, event_time, **limits):
    source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    turn_state.start(turn_state.batches(source, event_time, **limits), f"{folder}/out", f"{folder}/checkpoint", event_time)
    found = spark.read.schema(turn_state.BATCH_SCHEMA).parquet(f"{folder}/out").collect()
    return sorted((r.conv_id, r.batch, r.reason, r.turn_ids, r.texts) for r in found)


def test_event_time_with_restarts(spark):
    folder = shared_folder(spark, "turns")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put(spark, folder, [(1, "a", "x" * 10, 0, False), (1, "a", "again", 1, False), (1, "b", None, 3, None), (2, "a", "y", 2, False), (3, "p", "z" * 50, 1, False), (4, "q", "last", 5, True)])
    limits = {"chars": 40, "wait": 10_000, "idle": 1_000_000}
    size, close = (3, 0, "size", ["p"], ["z" * 50]), (4, 0, "close", ["q"], ["last"])
    assert run(spark, folder, True, **limits) == [size, close]
    assert run(spark, folder, True, **limits) == [size, close]  # nothing new, nothing twice
    # after a restart: ids that were seen are known, what waited goes on, and its wait is that of its first turn
    put(spark, folder, [(1, "b", "seen", 6, False), (1, "c", "x" * 30, 9, False), (2, "b", "w", 12, False), (3, "p", "seen", 7, False), (3, "r", "", 8, True)])
    first = (1, 0, "size", ["a", "b", "c"], ["x" * 10, None, "x" * 30])
    timed = (2, 0, "time", ["a"], ["y"])
    assert run(spark, folder, True, **limits) == [first, timed, size, (3, 1, "close", ["r"], [""]), close]
    # a conversation that was closed starts anew; one whose wait is over is flushed by the watermark alone
    put(spark, folder, [(4, "q", "again", 60, False)])
    assert (2, 1, "time", ["b"], ["w"]) in run(spark, folder, True, **limits)
    put(spark, folder, [(9, "x", "", 100, True)])
    assert (4, 0, "time", ["q"], ["again"]) in run(spark, folder, True, **limits)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_idle_conversations_end(spark):
    folder = shared_folder(spark, "turns")
    limits = {"chars": 1000, "wait": 10_000, "idle": 60_000}
    put(spark, folder, [(1, "a", "first", 0, False)])
    run(spark, folder, True, **limits)
    put(spark, folder, [(1, "a", "repeated", 30, False), (1, "b", "more", 31, False)])
    run(spark, folder, True, **limits)
    put(spark, folder, [(1, "a", "a new life", 200, True), (1, "b", "and another", 201, True)])
    assert run(spark, folder, True, **limits) == [
        (1, 0, "close", ["a"], ["a new life"]), (1, 0, "close", ["b"], ["and another"]), (1, 0, "time", ["a"], ["first"]), (1, 1, "time", ["b"], ["more"]),
    ]


def test_processing_time_timers(spark):
    folder = shared_folder(spark, "turns")
    limits = {"chars": 1000, "wait": 300, "idle": 3_600_000}
    put(spark, folder, [(1, "a", "x", 0, False), (1, "a", "x", 0, False), (2, "a", "y", 0, True)])
    assert (2, 0, "close", ["a"], ["y"]) in run(spark, folder, False, **limits)
    time.sleep(0.5)
    put(spark, folder, [(3, "a", "z", 0, True), (1, "a", "seen", 0, False)])
    assert run(spark, folder, False, **limits) == [(1, 0, "time", ["a"], ["x"]), (2, 0, "close", ["a"], ["y"]), (3, 0, "close", ["a"], ["z"])]
