"""Conversation turns as a stream: dedup, buffering with a size and a time limit, flush with quarantine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftloom.functions.text import redact
from siftloom.operators.chunking import conversation_chunks
from siftloom.session import ship

SEEN, FLUSH_CHARS, WAIT_MS, IDLE_MS = 2000, 4000, 90_000, 24 * 3600 * 1000
BATCH_SCHEMA = "conv_id long, batch long, reason string, turn_ids array<string>, texts array<string>"
STATE_SCHEMA = "seen array<string>, ids array<string>, texts array<string>, batch long, deadline long, last long"


class Buffer:
    """One conversation's state: the last SEEN turn ids, the waiting turns, and when the wait for them ends.

    The wait starts when the buffer is first seen non-empty and later turns
    don't prolong it; repeated turns change nothing.
    """

    def __init__(self, state: tuple | None = None):
        self.seen, self.ids, self.texts, self.batch, self.deadline, self.last = (list(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in state or ([], [], [], 0, 0, 0))

    def state(self) -> tuple:
        return self.seen, self.ids, self.texts, self.batch, self.deadline, self.last

    def add(self, turn_id: str, text: str | None, now: int) -> bool:
        if turn_id in self.seen:
            return False
        self.seen = [*self.seen, turn_id][-SEEN:]
        self.ids.append(turn_id)
        self.texts.append(text)
        self.last = now
        if len(self.ids) == 1:
            self.deadline = now + WAIT_MS
        return True

    def full(self) -> bool:
        return sum(len(t or "") for t in self.texts) >= FLUSH_CHARS

    def flush(self, reason: str) -> dict[str, Any] | None:
        if not self.ids:
            return None
        out = {"batch": self.batch, "reason": reason, "turn_ids": self.ids, "texts": self.texts}
        self.ids, self.texts, self.deadline = [], [], 0
        self.batch += 1
        return out


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes turns (conv_id, turn_id, text) and gives flushed batches; on timeout what waits is flushed, or an idle conversation ends."""
    buffer, now, out = Buffer(state.get if state.exists else None), state.getCurrentProcessingTimeMs(), []
    if state.hasTimedOut:
        out.append(buffer.flush("time"))
        if now - buffer.last >= IDLE_MS:
            state.remove()
            yield pd.DataFrame([{"conv_id": key[0], **x} for x in out if x], columns=["conv_id", "batch", "reason", "turn_ids", "texts"])
            return
    else:
        for frame in frames:
            for turn_id, text in zip(frame["turn_id"], frame["text"], strict=True):
                if buffer.add(turn_id, text, now) and buffer.full():
                    out.append(buffer.flush("size"))
    state.update(buffer.state())
    state.setTimeoutDuration(max(1, (buffer.deadline or buffer.last + IDLE_MS) - now))
    yield pd.DataFrame([{"conv_id": key[0], **x} for x in out if x], columns=["conv_id", "batch", "reason", "turn_ids", "texts"])


def batches(turns: DataFrame) -> DataFrame:
    """Flushed batches of a stream of turns (conv_id long, turn_id string, text string)."""
    ship(turns.sparkSession)
    return turns.select("conv_id", "turn_id", "text").groupBy("conv_id").applyInPandasWithState(step, BATCH_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout)


def masked_turns(flushed: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The turns of flushed batches: conv_id, batch, at (their place in the batch), turn_id, text (masked; null where masking failed) and counts of what was masked."""
    turns = flushed.select("conv_id", "batch", F.posexplode(F.arrays_zip("turn_ids", "texts")).alias("at", "x"))
    turns = turns.select("conv_id", "batch", "at", F.col("x.turn_ids").alias("turn_id"), redact("x.texts", extra).alias("masked"))
    return turns.select("conv_id", "batch", "at", "turn_id", F.col("masked.text").alias("text"), F.col("masked.counts").alias("counts"))


def flush_statistics(turns: DataFrame) -> DataFrame:
    """Of each flushed batch how many turns were kept and dropped, their characters, and how much was masked: conv_id, batch, kept, dropped, chars, masked."""
    masked = F.aggregate(F.map_values("counts"), F.lit(0), lambda a, x: a + x)
    return turns.groupBy("conv_id", "batch").agg(
        F.count("text").alias("kept"), F.count(F.when(F.col("text").isNull(), 1)).alias("dropped"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(F.col("text").isNotNull(), masked)), F.lit(0)).cast("long").alias("masked"),
    )


def dropped_letters(turns: DataFrame) -> DataFrame:
    """A letter for each turn that could not be masked, by identifiers alone: conv_id, batch, at, dedup_key, reason."""
    return turns.where("text is null").select("conv_id", "batch", "at", F.col("turn_id").alias("dedup_key"), F.lit("redaction_failed").alias("reason"))


def flush_writer(store: str, letters: str, extra: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: turns are masked, chunked and appended to ``store``; a turn that can't be masked goes to ``letters`` and its batch goes on.

    The path of a batch is its id, so a repeated batch overwrites itself.
    Indices go on from the counts of earlier batches, which are kept beside the
    chunks with the statistics of the flushes. Masked turns are worked out once
    for all that is written, and raw text never leaves the masking step.
    """

    def write(flushed: DataFrame, batch_id: int) -> None:
        turns = masked_turns(flushed, extra).persist()
        try:
            keyed = turns.where("text is not null").select("conv_id", F.struct("batch", "at").alias("turn"), "text")
            stored = _stored(flushed.sparkSession, f"{store}_counts", batch_id)
            path = f"{store}/batch={batch_id}"
            conversation_chunks(keyed, turn_col="turn", stored=stored).write.mode("overwrite").parquet(path)
            ends = flushed.sparkSession.read.parquet(path).groupBy("conv_id").agg((F.max("chunk_index") + 1).cast("long").alias("chunk_count"))
            ends.write.mode("overwrite").parquet(f"{store}_counts/batch={batch_id}")
            flush_statistics(turns).write.mode("overwrite").parquet(f"{store}_statistics/batch={batch_id}")
            dropped_letters(turns).write.mode("overwrite").parquet(f"{letters}/batch={batch_id}")
        finally:
            turns.unpersist()

    return write


def _stored(spark: SparkSession, counts: str, batch_id: int) -> DataFrame | None:
    """How many chunks each conversation has from earlier batches; a row a conversation and batch is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(counts)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("conv_id long, chunk_count long, batch long").parquet(counts).where(F.col("batch") < batch_id).groupBy("conv_id").agg(F.max("chunk_count").alias("chunk_count"))


def first_turns(turns: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """Turns of a stream, each id once within the watermark."""
    return turns.withWatermark(at, delay).dropDuplicatesWithinWatermark(["conv_id", "turn_id"])


def batches_offline(turns: DataFrame) -> DataFrame:
    """What a stream that ends flushes by size and close, for turns at rest (conv_id, nth, turn_id, text): conv_id, batch, reason, turn_ids, texts.

    A conversation's turns are walked in order, a batch of rows at a time; it
    takes no more memory than its buffer.
    """
    ship(turns.sparkSession)
    names = ["conv_id", "batch", "reason", "turn_ids", "texts"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, buffer = None, Buffer()
        for frame in frames:
            out: list[dict[str, Any]] = []
            for conv_id, turn_id, text in frame[["conv_id", "turn_id", "text"]].itertuples(index=False):
                if conv_id != now:
                    out += [{"conv_id": now, **x} for x in (buffer.flush("close"),) if x]
                    now, buffer = conv_id, Buffer()
                if buffer.add(turn_id, text, 0) and buffer.full():
                    out.append({"conv_id": now, **buffer.flush("size")})
            if out:
                yield pd.DataFrame(out, columns=names)
        if last := buffer.flush("close"):
            yield pd.DataFrame([{"conv_id": now, **last}], columns=names)

    rows = turns.select("conv_id", "nth", "turn_id", "text").where("conv_id is not null")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "nth", "turn_id").mapInPandas(run, BATCH_SCHEMA)
