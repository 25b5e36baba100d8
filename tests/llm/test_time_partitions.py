"""The partitions of clicks against a plain walk over the calendar, file by file."""

import calendar
import datetime as dt
import hashlib
import os
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftloom.llm import common, queries, time_partitions

CUTOFF = dt.datetime(2024, 4, 1)
COLUMNS = ["click_id", "ts", "arrived_at", "client_id", "part", "leaf"]
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, part string, leaf int"


def moment(r):
    if r[1] is None or r[0] is None:
        return r[1]
    k = zlib.crc32(str(r[0]).encode()) % 128
    if k < 16:
        return r[1] - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        return dt.datetime.combine(r[1].date() - dt.timedelta(days=r[1].weekday()), dt.time())
    return r[1]


def inside(rows, path):
    parts = ("year", "month", "day", "hour")
    return [r for r in rows if all(getattr(moment(r), p) == v for p, v in zip(parts, path, strict=False))]


def brute(rows, limit):
    """leaf and part of each file with its rows in order."""
    leaves = {}
    dated = [r for r in rows if moment(r) is not None]

    def walk(path, numbers, here):
        runs = []
        for i in numbers:
            child = inside(here, (*path, i))
            if len(child) > limit and len(path) < 3:
                y, m = (*path, i, 1)[:2]
                below = range(1, 13) if not path else range(1, calendar.monthrange(y, m)[1] + 1) if len(path) == 1 else range(24)
                walk((*path, i), below, child)
                runs.append(None)
            elif runs and runs[-1] is not None and len(runs[-1][2]) + len(child) <= limit:
                runs[-1] = (runs[-1][0], i, runs[-1][2] + child)
            else:
                runs.append((i, i, child))
        for run in runs:
            if run is not None and run[2]:
                name = "".join(("%04d/" if k == 0 else "%02d/") % p for k, p in enumerate(path))
                leaves[name + ("%02d-%02d" if path else "%04d-%04d") % run[:2]] = run[2]

    if dated:
        years = [moment(r).year for r in dated]
        walk((), range(min(years), max(years) + 1), dated)
    if len(dated) < len(rows):
        leaves["null"] = [r for r in rows if moment(r) is None]
    none = (0,)
    key = lambda r: [none if v is None else (1, v) for v in (moment(r), r[2], r[0], *r[1:2], *r[3:])]
    found = {}
    for leaf, here in leaves.items():
        here = sorted(here, key=key)
        for part in range(-(-len(here) // limit)):
            found[leaf, part + 1] = here[part * limit : (part + 1) * limit]
    return found


def some_rows(n, seed=1):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        ts = start + dt.timedelta(seconds=r.randrange(120 * 86400)) if r.random() < 0.6 else start + dt.timedelta(days=40, seconds=r.randrange(3 * 3600))
        arrived = ts + dt.timedelta(minutes=r.randrange(4000)) if r.random() < 0.95 else None
        out.append((i if r.random() < 0.98 else None, ts if r.random() < 0.93 else None, arrived, r.choice([None, 7, i]), r.choice([None, "", "é"]), r.choice([None, 1])))
    return out + out[:20] + [out[5]] * 7 + [(None, None, None, None, None, None)] * 3


def listed(folder):
    path = folder.removeprefix("file://").removeprefix("file:")
    return {os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")}


def checked(got, early, rows, limit, folder):
    """Every file is where and what the brute-force layout has; those of before stay exactly where it recurs."""
    before, after = brute(early, limit), brute(rows, limit)
    files = {(r.leaf, r.part): r for r in got.collect()}
    assert files.keys() == after.keys()
    told = set()
    for key, want in after.items():
        r = files[key]
        told.add(path := r.path.removeprefix("file://").removeprefix("file:"))
        table = pq.ParquetFile(path).read()
        assert ",".join(table.column_names) == r.columns == ",".join(COLUMNS)
        assert list(zip(*(table.column(c).to_pylist() for c in COLUMNS), strict=True)) == want
        ids = ",".join("" if w[0] is None else str(w[0]) for w in want)
        assert (r.n_rows, r.ids_sha256) == (len(want), hashlib.sha256(ids.encode()).hexdigest())
        assert r.n_new == sum(w[2] is None or w[2] >= CUTOFF for w in want)
        assert r.rewritten == (before.get(key) != want)
    assert told == listed(folder)
    return files


@pytest.mark.parametrize(("n", "limit"), [(400, 23), (150, 6), (60, 1000)])
def test_files_as_brute_force(spark, n, limit):
    rows = some_rows(n)
    clicks = spark.createDataFrame(rows, SCHEMA).repartition(3)
    early = F.coalesce(F.col("arrived_at") < F.lit(CUTOFF), F.lit(False))
    folder = common.fresh_path(spark, "layout")
    arrived = [r for r in rows if r[2] is not None and r[2] < CUTOFF]
    asked = (folder, limit, queries.click_moment("timestamp_ntz"), ("arrived_at", "click_id"))
    old = time_partitions.write_layout(clicks.where(early), *asked)
    first = {r.path.removeprefix("file://").removeprefix("file:") for r in old.collect()}
    assert {(r.leaf, r.part, r.n_rows) for r in old.collect()} == {(*k, len(v)) for k, v in brute(arrived, limit).items()}
    assert listed(folder) == first
    files = checked(time_partitions.rewrite_layout(clicks, *asked, old, ~early, "click_id"), arrived, rows, limit, folder)
    if n == 400:
        kinds = {(k == "null", k.count("/"), part > 1) for k, part in files}
        assert {(True, 0, True), (False, 0, False), (False, 2, False), (False, 3, True)} <= kinds
        assert {r.rewritten for r in files.values()} == {True, False}


def test_nothing_new_leaves_every_file(spark):
    clicks = spark.createDataFrame(some_rows(80, 3), SCHEMA)
    asked = (common.fresh_path(spark, "layout"), 9, queries.click_moment("timestamp_ntz"), ("arrived_at", "click_id"))
    old = time_partitions.write_layout(clicks, *asked)
    got = time_partitions.rewrite_layout(clicks, *asked, old, F.lit(False), "click_id").collect()
    assert {r.path for r in got} == {r.path for r in old.collect()}
    assert not any(r.rewritten or r.n_new for r in got)


@pytest.mark.parametrize("kept", ["false", "ts is null", "arrived_at >= timestamp_ntz'2024-04-01'"])
def test_empty_sides(spark, kept):
    rows = some_rows(60, 4)
    clicks = spark.createDataFrame(rows, SCHEMA).where(kept)
    folder = common.fresh_path(spark, "layout")
    asked = (folder, 4, queries.click_moment("timestamp_ntz"), ("arrived_at", "click_id"))
    early = F.coalesce(F.col("arrived_at") < F.lit(CUTOFF), F.lit(False))
    old = time_partitions.write_layout(clicks.where(early), *asked)
    got = time_partitions.rewrite_layout(clicks, *asked, old, ~early, "click_id")
    left = [tuple(r) for r in clicks.collect()]
    if not left:
        assert got.count() == 0
        return
    checked(got, [r for r in left if r[2] is not None and r[2] < CUTOFF], left, 4, folder)


def test_siblings_fold_in_time_order(spark):
    hours = spark.createDataFrame([(time_partitions.NO_HOUR, 3), (0, 1), (24 * 800, 9), (24 * 800 + 3, 2), (24 * 900, 3), (24 * 2000, 1)], "hour long, n long")
    got = {(r.leaf, r.n) for r in time_partitions.leaves(hours, 4).collect()}
    assert got == {("null", 3), ("1970-1971", 1), ("1972/03/11/00-00", 9), ("1972/03/11/01-23", 2), ("1972/04-12", 3), ("1973-1975", 1)}
