"""Adaptive time partitions: files of about equal size that follow the calendar, rewritten only where rows came.

A node of the calendar (a year, month, day or hour) that holds more rows than
the limit is split into all its children; neighbours within the limit are put
together as long as they stay within it. ROLLUP counts all levels at once, joins
of that table with itself keep the children of overfull nodes, calendar
sequences add empty children, and ``aggregate()`` folds the sorted siblings of a
parent into runs. Rows find their run by the range of its hours.

The tree is small whatever the table's size: at most rows / limit nodes of a
level are overfull. Rows themselves are only sorted and dealt, one file a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftloom.llm.common import cut
from siftloom.session import ship

#: The hour that rows without a moment have, before any calendar.
NO_HOUR = -24_000_000_000
#: What stands for rows without a moment among the leaves' names.
NO_MOMENT = "null"

_RUN = "struct<first:int,last:int,begin:bigint,end:bigint,n:bigint>"


def hour_of(moment: Column) -> Column:
    """Hours since 1970, NO_HOUR for null."""
    days = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return F.coalesce(days * 24 + F.hour(moment), F.lit(NO_HOUR).cast("long"))


def _date_of(hour: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(hour / 24).cast("int"))


def _hours_to(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * 24


def _named(*parts: tuple[str, str]) -> Column:
    return F.format_string("".join(f for f, _ in parts), *(F.col(c) for _, c in parts)) if parts else F.lit("")


def siblings(hours: DataFrame, limit: int) -> DataFrame:
    """The children of all overfull nodes, empty ones too: level, parent (a name that ends in ``/``), at, begin and end (hours), n.

    ``hours`` has hour and n. The years from the first to the last one are the
    children of the root.
    """
    date = _date_of(F.col("hour"))
    dated = hours.where(F.col("hour") != NO_HOUR).select(F.year(date).alias("y"), F.month(date).alias("m"), F.dayofmonth(date).alias("d"), F.pmod("hour", F.lit(24)).cast("int").alias("h"), "n")
    nodes = cut(dated.rollup("y", "m", "d", "h").agg(F.sum("n").alias("n"), F.grouping_id().alias("above")), "nodes")
    years, months, days, all_hours = (nodes.where(F.col("above") == k).select(*keys, "n") for k, keys in ((7, "y"), (3, "ym"), (1, "ymd"), (0, "ymdh")))

    def children(parents: DataFrame, key: str, numbers: Column, counted: DataFrame) -> DataFrame:
        every = parents.withColumn(key, F.explode(numbers))
        return every.join(counted, every.columns, "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def overfull(counted: DataFrame) -> DataFrame:
        return counted.where(F.col("n") > limit).drop("n")

    def listed(found: DataFrame, level: int, parent: Column, at: str, begin: Column, end: Column) -> DataFrame:
        return found.select(F.lit(level).alias("level"), parent.alias("parent"), F.col(at).alias("at"), begin.alias("begin"), (end - 1).alias("end"), "n")

    span = years.agg(F.min("y").alias("low"), F.max("y").alias("high"))
    every_year = span.select(F.explode(F.sequence("low", "high")).alias("y")).join(years, "y", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_month = children(overfull(years), "m", F.sequence(F.lit(1), F.lit(12)), months)
    by_day = children(overfull(months), "d", F.sequence(F.lit(1), F.dayofmonth(F.last_day(F.make_date("y", "m", F.lit(1))))), days)
    by_hour = children(overfull(days), "h", F.sequence(F.lit(0), F.lit(23)), all_hours)

    first, day = F.make_date("y", "m", F.lit(1)), _hours_to(F.make_date("y", "m", "d"))
    year, month, date_ = ("%04d/", "y"), ("%02d/", "m"), ("%02d/", "d")
    return (
        listed(every_year, 0, _named(), "y", _hours_to(F.make_date("y", F.lit(1), F.lit(1))), _hours_to(F.make_date(F.col("y") + 1, F.lit(1), F.lit(1))))
        .unionByName(listed(by_month, 1, _named(year), "m", _hours_to(first), _hours_to(F.add_months(first, 1))))
        .unionByName(listed(by_day, 2, _named(year, month), "d", day, day + 24))
        .unionByName(listed(by_hour, 3, _named(year, month, date_), "h", day + F.col("h"), day + F.col("h") + 1))
    )


def _folded(limit: int) -> Column:
    """The sorted array ``siblings`` as runs: each sibling joins the run before it if that stays within the limit."""

    def step(state: Column, x: Column) -> Column:
        run = state["run"]
        alone = F.struct(x["at"].alias("first"), x["at"].alias("last"), x["begin"].alias("begin"), x["end"].alias("end"), x["n"].alias("n"))
        longer = F.struct(run["first"].alias("first"), x["at"].alias("last"), run["begin"].alias("begin"), x["end"].alias("end"), (run["n"] + x["n"]).alias("n"))
        joins = run["n"] + x["n"] <= limit
        return (
            F.when(run.isNull(), F.struct(state["done"].alias("done"), alone.alias("run")))
            .when(joins, F.struct(state["done"].alias("done"), longer.alias("run")))
            .otherwise(F.struct(F.concat(state["done"], F.array(run)).alias("done"), alone.alias("run")))
        )

    start = F.expr(f"named_struct('done', cast(array() as array<{_RUN}>), 'run', cast(null as {_RUN}))")
    return F.aggregate("siblings", start, step, lambda s: F.concat(s["done"], F.array(s["run"])))


def leaves(hours: DataFrame, limit: int) -> DataFrame:
    """The leaves with rows: leaf (its name), level, begin and end (hours), n, first_file.

    Runs, hours above the limit, and all rows without a moment. A leaf of n
    rows takes ceil(n / limit) files, numbered on from ``first_file``.
    """
    grouped = siblings(hours, limit).groupBy("level", "parent").agg(F.sort_array(F.collect_list(F.struct("at", "begin", "end", "n"))).alias("siblings"))
    runs = grouped.select("level", "parent", F.explode(_folded(limit)).alias("run"))
    runs = runs.where((F.col("run.n") > 0) & ((F.col("run.n") <= limit) | (F.col("level") == 3)))
    number = F.when(F.col("level") == 0, F.format_string("%04d-%04d", "run.first", "run.last")).otherwise(F.format_string("%02d-%02d", "run.first", "run.last"))
    found = runs.select(F.concat("parent", number).alias("leaf"), "level", "run.begin", "run.end", "run.n")
    without = hours.where((F.col("hour") == NO_HOUR) & (F.col("n") > 0))
    found = found.unionByName(without.select(F.lit(NO_MOMENT).alias("leaf"), F.lit(3).alias("level"), F.col("hour").alias("begin"), F.col("hour").alias("end"), "n"))
    files = F.ceil(F.col("n") / limit)
    before = Window.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)  # the leaves are few, whatever the rows
    return cut(found.withColumn("first_file", F.coalesce(F.sum(files).over(before), F.lit(0)).cast("int")), "leaves")


def files_of(found: DataFrame, limit: int) -> DataFrame:
    """leaf, part (from 1) and file (from 0) of each file of the leaves."""
    return found.select("leaf", F.posexplode(F.sequence(F.lit(1), F.ceil(F.col("n") / limit))).alias("at", "part"), "first_file").select("leaf", "part", (F.col("first_file") + F.col("at")).alias("file"))


def dealt(rows: DataFrame, found: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """The rows (with ``_hour``) with ``_file``, the number of their file.

    Leaves are joined by range: those below a year by their days, runs of
    years by their years, so that the broadcast has at most the days of the
    overfull years. Leaves above the limit are cut into parts by each row's place
    in a distributed sort.
    """
    kept = rows.columns
    leaf = ["begin", "end", "n", "first_file"]
    fine = found.where("level > 0").select(*leaf, F.explode(F.sequence(F.floor(F.col("begin") / 24), F.floor(F.col("end") / 24))).alias("_day"))
    coarse = found.where("level = 0").select(*leaf, F.explode(F.sequence(F.year(_date_of(F.col("begin"))), F.year(_date_of(F.col("end"))))).alias("_year"))

    def struct(bins: DataFrame, key: str) -> DataFrame:
        return F.broadcast(bins.select(key, F.struct(*leaf).alias(f"{key}_leaf")))

    def inside(name: str) -> Column:
        return F.col("_hour").between(F.col(f"{name}.begin"), F.col(f"{name}.end"))

    keyed = rows.withColumns({"_on_day": F.floor(F.col("_hour") / 24), "_in_year": F.year(_date_of(F.col("_hour")))})
    joined = keyed.join(struct(fine, "_day"), (F.col("_on_day") == F.col("_day")) & inside("_day_leaf"), "left")
    joined = joined.join(struct(coarse, "_year"), (F.col("_in_year") == F.col("_year")) & inside("_year_leaf"), "left")
    told = joined.withColumn("_leaf", F.coalesce("_day_leaf", "_year_leaf")).select(*kept, F.col("_leaf.n").alias("_n"), F.col("_leaf.first_file").alias("_first"))
    single = told.where(F.col("_n") <= limit).select(*kept, F.col("_first").alias("_file"))
    return single.unionByName(_in_parts(told.where(F.col("_n") > limit).drop("_n"), limit, order).select(*kept, "_file"))


def _in_parts(rows: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """Rows of large leaves with the file that their place in the leaf's order gives."""
    ranges = rows.repartitionByRange("_first", *order).sortWithinPartitions("_first", *order)
    placed = cut(ranges.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range", "_first").agg(F.count(F.lit(1)).alias("_count"), F.min("_at").alias("_low"))
    before = Window.partitionBy("_first").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", "_first", "_low", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at") - F.col("_low")
    # a row for each range and for each leaf that starts in one
    return placed.join(F.broadcast(counts), ["_range", "_first"]).withColumn("_file", (F.col("_first") + F.floor(rank / limit)).cast("int"))


def _write(rows: DataFrame, n_files: int, columns: Sequence[str], order: Sequence[str], folder: str) -> None:
    """One Parquet file for each number in ``_file``, its rows in order; the file's name tells the number."""
    sorted_ = rows.repartitionById(n_files, F.col("_file").cast("int")).sortWithinPartitions(*order)
    sorted_.select(*columns).write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)


def _sums(columns: Sequence[str]) -> list[Column]:
    """A number of rows and two sums of hashes, which equal rows have alike in any order."""
    hashes = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    return [F.count(F.lit(1)).alias("n_rows"), *hashes]


def _number(path: str) -> Column:
    return F.regexp_extract(F.col(path), r"part-(\d+)-[^/]*$", 1).try_cast("int")


def ids_digest(rows: DataFrame) -> DataFrame:
    """path, ids_sha256 of rows (path, at, id): the hash of the ids in the order of ``at``, as decimal numbers with commas between them, null as nothing.

    A file's rows stream through one task; nothing of them is held.
    """
    ship(rows.sparkSession)
    streamed = rows.select("path", "at", F.col("id").cast("string").alias("id")).repartition("path").sortWithinPartitions("path", "at").select("path", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["path", "ids_sha256"])

        for batch in batches:
            if not batch.num_rows:
                continue
            paths, ids = batch.column("path").dictionary_encode(), batch.column("id").to_pylist()
            code = paths.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                path = paths.dictionary[int(code[a])].as_py()
                text = ",".join([i or "" for i in ids[a:b]]).encode()
                if path == now:
                    digest.update(b"," + text)
                    continue
                if now is not None:
                    yield done()
                now, digest = path, sha256(text)
        if now is not None:
            yield done()

    return streamed.mapInArrow(run, "path string, ids_sha256 string")


def write_layout(rows: DataFrame, folder: str, limit: int, moment: Column, order: Sequence[str]) -> DataFrame:
    """Write rows into a folder and return its files: leaf, part, path, n_rows, sum1, sum2.

    Rows of a leaf are sorted by moment, then the columns of ``order``, then the
    others, nulls first. The folder gets one Parquet file for each part of
    ``limit`` rows of a leaf; a table without rows gives none.
    """
    spark, columns = rows.sparkSession, rows.columns
    told, by = _prepared(rows, moment, order)
    hours = cut(told.groupBy(F.col("_hour").alias("hour")).agg(F.count(F.lit(1)).alias("n")), "hours")
    found = leaves(hours, limit)
    files = files_of(found, limit)
    if n_files := files.count():
        _write(dealt(told, found, limit, by), n_files, columns, by, folder)
    return cut(_stored(spark, folder, rows, bool(n_files)).join(files, "file").select("leaf", "part", "path", "n_rows", "sum1", "sum2"), "files")


def _prepared(rows: DataFrame, moment: Column, order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    told = rows.withColumn("_moment", moment)
    return told.withColumn("_hour", hour_of(F.col("_moment"))), ["_moment", *order, *(c for c in rows.columns if c not in order)]


def _stored(spark: SparkSession, folder: str, like: DataFrame, any_: bool) -> DataFrame:
    """file (the number in its name), path, n_rows, sum1, sum2 of what lies in the folder."""
    stored = _read(spark, folder, like, any_)
    return stored.groupBy("path").agg(*_sums(like.columns)).withColumn("file", _number("path"))


def _read(spark: SparkSession, folder: str, like: DataFrame, any_: bool) -> DataFrame:
    if not any_:
        return spark.createDataFrame([], like.schema).withColumns({"path": F.lit(""), "at": F.lit(0)})
    return spark.read.schema(like.schema).parquet(folder).select(*like.columns, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))


def rewrite_layout(rows: DataFrame, folder: str, limit: int, moment: Column, order: Sequence[str], old: DataFrame, is_new: Column, id_col: str) -> DataFrame:
    """Bring a folder that ``write_layout`` filled to the layout of more rows; return its files.

    ``old`` are the files that lie there, ``is_new`` tells rows that none of them
    holds. Files whose leaf, part and rows are those of a file there stay as they
    are; the others are written first, then what has no place any more goes, so
    that a run that breaks off loses no row. Columns: leaf, part, path, columns,
    ids_sha256, n_rows, n_new, rewritten.
    """
    spark, columns = rows.sparkSession, rows.columns
    told, by = _prepared(rows.withColumn("_new", F.coalesce(is_new, F.lit(True))), moment, order)
    by = [c for c in by if c != "_new"]
    hours = cut(told.groupBy(F.col("_hour").alias("hour")).agg(F.count(F.lit(1)).alias("n")), "hours")
    found = leaves(hours, limit)
    placed = dealt(told, found, limit, by)
    sums = placed.groupBy(F.col("_file").alias("file")).agg(F.sum(F.col("_new").cast("long")).alias("n_new"), *_sums(columns))
    same = [F.col(f"new.{c}") == F.col(f"old.{c}") for c in ("leaf", "part", "n_rows", "sum1", "sum2")]
    plan = sums.join(files_of(found, limit), "file").alias("new").join(old.alias("old"), same, "left")
    plan = plan.select(*(F.col(f"new.{c}") for c in ("file", "leaf", "part", "n_new")), F.col("old.path").alias("kept"))
    place = F.row_number().over(Window.partitionBy(F.col("kept").isNull()).orderBy("file")) - 1  # the files are few, whatever the rows
    plan = cut(plan.withColumn("place", place), "plan")
    changed = plan.where("kept is null")
    if n_files := changed.count():
        moved = placed.join(F.broadcast(changed.select(F.col("file").alias("_file"), F.col("place").alias("_place"))), "_file")
        _write(moved.drop("_file").withColumnRenamed("_place", "_file"), n_files, columns, by, folder)
    gone = [r.path for r in old.join(plan, old.path == plan.kept, "left_anti").select("path").collect()]  # at most a few thousand, by the limit's share of the rows
    paths = spark._jvm.org.apache.hadoop.fs.Path
    for path in gone:
        paths(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(paths(path), False)
    stored = _read(spark, folder, rows, bool(n_files) or bool(plan.count()))
    digests = ids_digest(stored.select("path", "at", F.col(id_col).alias("id"))).join(stored.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows")), "path")
    of_new = digests.join(old, "path", "left_anti").withColumn("place", _number("path")).join(changed, "place").withColumn("rewritten", F.lit(True))
    of_old = digests.join(plan.where("kept is not null").withColumnRenamed("kept", "path"), "path").withColumn("rewritten", F.lit(False))
    named = ["leaf", F.lit(",".join(columns)).alias("columns"), "ids_sha256", "path", F.col("part").cast("long").alias("part"), "n_rows", "n_new", "rewritten"]
    return cut(of_new.select(*named).unionByName(of_old.select(*named)), "files")
