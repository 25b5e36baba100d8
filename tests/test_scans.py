"""Running sums, maxima and floored walks against plain loops, with one key over many ranges."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from siftloom.operators import scans, search, stats


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables would be put together into one range."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def steps(n, seed=1):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "hot", "a", None]), i, r.choice([None, -3, -2, -1, 0, 1, 2, 3])) for i in r.sample(range(10 * n), n)]


def by_key(rows):
    found = {}
    for key, at, value in sorted(rows, key=lambda r: r[1]):
        found.setdefault(key, []).append((at, value))
    return found


def test_running_sum_and_greatest_before(spark):
    rows = steps(600)
    df = spark.createDataFrame(rows, "k string, at int, v int")
    told = scans.ranged(df, ["k"], ["at"])
    assert told.where("k = 'hot'").select("_range").distinct().count() > 1
    got = scans.greatest_before(scans.running_sum(told, ["k"], ["at"], F.col("v"), "total"), ["k"], ["at"], "v", "most")
    want = {}
    for key, walk in by_key(rows).items():
        sums, most = list(accumulate(v or 0 for _, v in walk)), None
        for (at, v), total in zip(walk, sums, strict=True):
            want[key, at] = total, most
            most = v if most is None else most if v is None else max(most, v)
    assert {(r.k, r.at): (r.total, r.most) for r in got.collect()} == want


def test_floored_sum_of_one_key_over_many_ranges(spark):
    rows = [(k, at, v) for k, at, v in steps(800, 2) if v is not None]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    want = {}
    for key, walk in by_key(rows).items():
        value = 0
        for _, v in walk:
            value = max(0, value + v)
        want[key] = value
    assert {r.k: r.value for r in scans.floored_sum(df, ["k"], ["at"], "v", "value").collect()} == want
    assert scans.floored_sum(df.limit(0), ["k"], ["at"], "v", "value").count() == 0


def test_a_million_steps_of_one_key_take_many_tasks(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("run"), F.col("id").alias("at"), (F.col("id") % 7 - 3).alias("v"))
    value = 0
    for i in range(n):
        value = max(0, value + i % 7 - 3)
    ranges = scans.ranged(df, ["k"], ["at"]).groupBy("_range").count().collect()
    assert len(ranges) > 2 and max(r["count"] for r in ranges) < n / 2
    assert [tuple(r) for r in stats.floored_counters(df, "k", "run", "at", "v").collect()] == [("hot", value)]


def test_a_long_document_and_islands(spark):
    chunks = spark.createDataFrame([("d", i, "x" * (i % 5)) for i in range(300)] + [("e", 0, None)], "document_id string, chunk_index int, content string")
    got = {(r.document_id, r.chunk_index): (r.from_char, r.to_char) for r in search.character_places(chunks).where("content is not null").collect()}
    at, want = 0, {}
    for i in range(300):
        want["d", i] = at, at + i % 5
        at += i % 5 + 2
    assert got == want
    indices = sorted(random.Random(3).sample(range(900), 200))
    spans = search.window_ranges(spark.createDataFrame([("d", i) for i in indices] * 2, "document_id string, chunk_index int"), 1)
    merged = []
    for i in indices:
        if merged and max(i - 1, 0) <= merged[-1][1] + 1:
            merged[-1][1] = i + 1
        else:
            merged.append([max(i - 1, 0), i + 1])
    assert sorted([r.lo, r.hi] for r in spans.collect()) == merged


def test_first_hit_windows_of_one_key_over_many_ranges(spark):
    import datetime as dt

    from siftloom.streaming import limits

    r = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    events = [(r.choice(["hot", "hot", "hot", "b", None]), base + dt.timedelta(seconds=r.randrange(4000) / 2), i) for i in range(700)] + [("hot", base, 1000), ("hot", None, 1001)]
    df = spark.createDataFrame(events, "k string, ts timestamp, event_id int")
    want, state = {}, {}
    for k, ts, i in sorted((e for e in events if e[0] and e[1]), key=lambda e: (e[1], e[2])):
        start, n = state.get(k, (None, 0))
        if start is None or ts >= start + dt.timedelta(seconds=30):
            start, n = ts, 0
        state[k] = start, n + 1
        want[i] = (start, n + 1, n + 1 <= 2)
    got = limits.first_hit_windows(df, "k", "ts", 2, 30)
    assert {x.event_id: (x.window_start, x.nth, x.allowed) for x in got.collect()} == want
    assert limits.first_hit_windows(df.limit(0), "k", "ts", 2, 30).count() == 0
