"""Conversation turns as a stream with keyed state: each id once, batches by size, by time and at the close, an end after idleness.

State is kept by conversation in the state store: a map of the turn ids that were
seen, a list of the turns that wait, and one row of marks. A turn reads and
writes its own entries only; nothing is rewritten whole. Timers flush what has
waited long enough and end conversations that are idle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftloom.session import ship
from siftloom.streaming.conversations import BATCH_SCHEMA, FLUSH_CHARS, IDLE_MS, WAIT_MS

NAMES = ["conv_id", "batch", "reason", "turn_ids", "texts"]
#: What the state store of these streams must be.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turns(StatefulProcessor):
    """The life of a conversation.

    In event time a turn's own time counts, in processing time the clock. A
    batch ends when it holds ``chars`` characters, when a turn comes ``wait`` ms
    after its first turn or later, or a timer says so, and at a turn marked as
    closed, which also ends the conversation. A conversation without a turn for
    ``idle`` ms ends: what waits is flushed and all of its state goes, so that an
    id may come again. In processing time ids also go by themselves after
    ``idle`` ms. Turns of a micro-batch are taken in the order of their time, then
    their id; a null text has no characters.
    """

    def __init__(self, event_time: bool, chars: int = FLUSH_CHARS, wait: int = WAIT_MS, idle: int = IDLE_MS):
        self.event_time, self.chars, self.wait, self.idle = event_time, chars, wait, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "turn_id string", "at long", None if self.event_time else self.idle)
        self.waiting = handle.getListState("waiting", "turn_id string, text string")
        self.marks = handle.getValueState("marks", "batch long, chars long, deadline long, ends long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802  the API's names
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        came = sorted(((r.at_ms, r.turn_id or "", r.text, bool(r.closed)) for frame in rows for r in frame.itertuples(index=False)), key=lambda r: r[:2])
        out: list[dict] = []
        batch, chars, deadline, ends = before = self._marks()
        for at, turn_id, text, closed in came:
            at = at if now is None else now
            if ends and at >= ends:
                batch, chars, deadline = self._flushed(out, batch, "time", deadline)
                self._cleared()
                batch = ends = 0
            elif deadline and at >= deadline:
                batch, chars, deadline = self._flushed(out, batch, "time", deadline)
            if not self.seen.containsKey((turn_id,)):
                self.seen.updateValue((turn_id,), (at,))
                self.waiting.appendValue((turn_id, None if pd.isna(text) else text))
                chars += 0 if pd.isna(text) else len(text)
                deadline = deadline or at + self.wait
                ends = at + self.idle
                if chars >= self.chars:
                    batch, chars, deadline = self._flushed(out, batch, "size", deadline)
            if closed:
                self._flushed(out, batch, "close", deadline)
                self._cleared()
                batch = chars = deadline = ends = 0
        self._timers(before[2:], (deadline, ends))
        if ends:
            self.marks.update((batch, chars, deadline, ends))
        else:
            self.marks.clear()
        yield from self._told(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        batch, chars, deadline, ends = self._marks()
        if deadline and (now >= deadline or now >= ends):
            batch, chars, deadline = self._flushed(out, batch, "time", deadline)
            self.marks.update((batch, chars, deadline, ends))
        if ends and now >= ends:
            self._cleared()
        yield from self._told(key, out)

    def close(self) -> None:
        pass

    def _marks(self) -> tuple[int, int, int, int]:
        return tuple(self.marks.get()) if self.marks.exists() else (0, 0, 0, 0)

    def _flushed(self, out: list[dict], batch: int, reason: str, deadline: int) -> tuple[int, int, int]:
        """What waits as a batch, if there is any; then the marks of an empty one."""
        if not deadline:
            return batch, 0, 0
        turns = list(self.waiting.get())
        out.append({"batch": batch, "reason": reason, "turn_ids": [t[0] for t in turns], "texts": [t[1] for t in turns]})
        self.waiting.clear()
        return batch + 1, 0, 0

    def _cleared(self) -> None:
        self.seen.clear()
        self.waiting.clear()
        self.marks.clear()

    def _timers(self, old: tuple[int, ...], new: tuple[int, ...]) -> None:
        for t in {*old} - {*new, 0}:
            self.handle.deleteTimer(t)
        for t in {*new} - {*old, 0}:
            self.handle.registerTimer(t)

    def _told(self, key: tuple, out: list[dict]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([{"conv_id": key[0], **x} for x in out], columns=NAMES)


def batches(turns: DataFrame, event_time: bool = False, delay: str = "0 seconds", **limits: int) -> DataFrame:
    """Flushed batches of a stream of turns (conv_id long, turn_id string, text string, at timestamp, closed boolean): conv_id, batch, reason, turn_ids, texts.

    ``limits``: chars, wait and idle of :class:`Turns`. In event time turns may be
    ``delay`` late against the latest one. The session must use the RocksDB state
    store (see :func:`start`).
    """
    ship(turns.sparkSession)
    rows = turns.selectExpr("conv_id", "turn_id", "text", "unix_millis(at) AS at_ms", "coalesce(closed, false) AS closed", "at")
    rows = rows.withWatermark("at", delay) if event_time else rows.drop("at")
    mode = "EventTime" if event_time else "ProcessingTime"
    return rows.groupBy("conv_id").transformWithStateInPandas(Turns(event_time, **limits), BATCH_SCHEMA, "Append", mode)


def start(flushed: DataFrame, path: str, checkpoint: str, event_time: bool = False) -> None:
    """Run the stream over all that its source holds now, appending its batches to Parquet files at ``path``, and wait for its end.

    A later call with the same checkpoint goes on where this one ended: files are
    written once, and the state is that of the last one. Timers of processing time
    are looked at with the next turns, whatever conversation they are of.
    """
    spark: SparkSession = flushed.sparkSession
    # in processing time batches without data would never end
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str(event_time).lower()}
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        query = flushed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    query.awaitTermination()
