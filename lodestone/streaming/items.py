"""A session of items as a state machine over a stream of events, and resumable stages on it.

Each item goes from queued over running to completed, and from there to what the stage decides: accepted, rejected, held;
or it is cancelled or fails. ``transitions`` is a table, so a session with other steps is another table. An event that is
not allowed in the item's state changes nothing and is a row of the output; so is one that came after a later one of its
item was taken. A retry is an event like any other: failed, held and cancelled items go on only on request, and only so
often. An item that stays running longer than ``patience`` fails: at its next event, or when the watermark passes its time.

State is one small row for each item, kept by the state store, so that a run that starts again from its checkpoint goes
on where it was; the log of changes is the session's record, and the state of every item is its last change.

Cases: null items are an item; events of one time go by event id; unknown events are illegal; repeated events are taken once
more and so mostly illegal; a stream without events gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship
from .events import work_folder

#: (state before, event) to state after; "" is an item that is not there yet.
TRANSITIONS = {
    ("", "queue"): "queued", ("queued", "start"): "running", ("queued", "cancel"): "cancelled", ("running", "complete"): "completed", ("running", "cancel"): "cancelled", ("running", "fail"): "failed",
    ("completed", "accept"): "accepted", ("completed", "reject"): "rejected", ("completed", "hold"): "held", ("held", "retry"): "queued", ("failed", "retry"): "queued", ("cancelled", "retry"): "queued",
}
RUNNING, FAILED, RETRY, TIMED_OUT = "running", "failed", "retry", "time_out"
CHANGES = "item string, ts timestamp, event_id long, event string, before string, after string, outcome string, attempts int, n long"


class _Item(StatefulProcessor):
    """One item: (status, since, last, attempts, n) and a timer while it runs."""

    def __init__(self, transitions: dict, patience: timedelta, retries: int):
        self.transitions, self.patience, self.retries = transitions, patience, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, since timestamp, last timestamp, attempts int, n long")

    def _held(self) -> list:
        return list(self.state.get()) if self.state.exists() else ["", None, None, 0, 0]

    def _out(self, item, changes: list) -> Iterator[pd.DataFrame]:
        if changes:
            out = pd.DataFrame([(item, *c) for c in changes], columns=["item", "ts", "event_id", "event", "before", "after", "outcome", "attempts", "n"])
            out["event_id"] = out["event_id"].astype("Int64")
            yield out

    def _timed_out(self, s: list, changes: list) -> None:
        s[0], s[1], s[2], s[4] = FAILED, None, s[1] + self.patience, s[4] + 1
        changes.append((s[2], None, TIMED_OUT, RUNNING, FAILED, "timed_out", s[3], s[4]))

    def _rearm(self, s: list) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s[0] == RUNNING:
            self.handle.registerTimer(int(pd.Timestamp(s[1] + self.patience, tz="UTC").timestamp() * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        s, changes = self._held(), []
        for ts, number, event in zip(events["ts"], events["event_id"], events["event"]):
            ts = ts.to_pydatetime()
            if s[0] == RUNNING and ts > s[1] + self.patience:
                self._timed_out(s, changes)
            before, after = s[0], self.transitions.get((s[0], event))
            late = s[2] is not None and ts < s[2]
            spent = event == RETRY and s[3] >= self.retries
            s[4] += 1
            if late or after is None or spent:
                changes.append((ts, number, event, before, before, "late" if late else "retries_spent" if after is not None else "illegal", s[3], s[4]))
                continue
            s[0], s[1], s[2], s[3] = after, ts if after == RUNNING else None, ts, s[3] + (event == RETRY)
            changes.append((ts, number, event, before, after, "taken", s[3], s[4]))
        self.state.update(tuple(s))
        self._rearm(s)
        yield from self._out(key[0], changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, changes = self._held(), []
        if s[0] == RUNNING:
            self._timed_out(s, changes)
            self.state.update(tuple(s))
        yield from self._out(key[0], changes)

    def close(self) -> None:
        pass


def item_changes(events: DataFrame, patience: str | timedelta = timedelta(hours=6), retries: int = 3, late: str = "0 seconds", transitions: dict | None = None) -> DataFrame:
    """The changes of a stream of events (item, ts, event_id, event): taken ones and, with their outcome, those that were not."""
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    patience = patience if isinstance(patience, timedelta) else pd.Timedelta(patience).to_pytimedelta()
    timed = events.select(F.col("item").cast("string"), F.col("ts").cast("timestamp"), F.col("event_id").cast("long"), "event").withWatermark("ts", late)
    return timed.groupBy("item").transformWithStateInPandas(_Item(transitions or TRANSITIONS, patience, retries), CHANGES, "Append", "EventTime")


def run_session(events: DataFrame, folder: str, **options):
    """Take what the stream has now into the session of ``folder``: its log of changes, and the checkpoint from which the next run goes on."""
    changes = item_changes(events, **options)
    return changes.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def log_of(spark, folder: str) -> DataFrame:
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes")


def states(changes: DataFrame) -> DataFrame:
    """Each item with its status, the time of its last change, attempts, and how many events were taken and not."""
    taken = F.col("outcome").isin("taken", "timed_out")
    last = F.max_by(F.struct("after", "ts"), F.when(taken, F.col("n")))
    out = changes.groupBy("item").agg(last.alias("s"), F.max("attempts").alias("attempts"), F.count_if(F.col("outcome") == "taken").alias("taken"), F.count_if(F.col("outcome") == "timed_out").alias("timed_out"), F.count_if(~taken).alias("refused"))
    return out.select("item", F.coalesce("s.after", F.lit("")).alias("status"), F.col("s.ts").alias("since"), "attempts", "taken", "timed_out", "refused")


def states_of_files(spark, folder: str, schema: str, event, pattern: str = "*", **options) -> DataFrame:
    """The states after all files of a folder, read as a stream and run to the end; ``event``: a function from their rows to events."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    work = work_folder(spark)
    run_session(event(stream), work, **options).awaitTermination()
    return states(log_of(spark, work))
