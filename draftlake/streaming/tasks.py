"""Streams of task messages, arriving files and index updates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rows import task_states
from ..sources.stores import ChunkIndex

_RANK = {"START": 0, "PROGRESS": 1, "FINISH": 2, "FAIL": 2}


def task_state_stream(messages: DataFrame) -> DataFrame:
    """Status and progress of each task as messages (task_id, kind, ts, value) come; for update mode."""
    return task_states(messages)


class _Transitions(StatefulProcessor):
    """Keeps a task's status and the time of its last message; a timer drops them a day of event time after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "status string, last timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, last = self.held.get() if self.held.exists() else ("PENDING", None)
        for part in rows:
            out = []
            for r in part.sort_values(["ts", "kind"], key=lambda c: c.map(_RANK) if c.name == "kind" else c).itertuples():
                legal = status not in ("SUCCESS", "FAILURE") and (last is None or r.ts >= last)
                if legal:
                    status, last = {"FINISH": "SUCCESS", "FAIL": "FAILURE"}.get(r.kind, "RUNNING"), r.ts
                out.append((key[0], r.ts, r.kind, status, legal))
            yield pd.DataFrame(out, columns=["task_id", "ts", "kind", "status", "legal"])
        self.held.update((status, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), int(last.timestamp() * 1000)) + 86_400_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def legal_transitions(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each message (task_id, kind, ts) with its task's status after it; messages behind FINISH or FAIL, or behind the watermark, change nothing.

    A task without messages for a day is forgotten.  State is kept in RocksDB, which this sets for the session's streams.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = "task_id long, ts timestamp, kind string, status string, legal boolean"
    seen = messages.select("task_id", "kind", "ts").withWatermark("ts", late)
    return seen.groupBy("task_id").transformWithStateInPandas(statefulProcessor=_Transitions(), outputStructType=out, outputMode="append", timeMode="eventTime")


def new_files(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Arriving files (identity, ts, …), each identity once within the watermark."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark(["identity"])


def keep_index(chunks: DataFrame, index: ChunkIndex):
    """A writer that replaces, in the index, the chunks of the sources that a batch brings; a batch that runs again changes nothing."""
    return chunks.writeStream.foreachBatch(lambda batch, number: index.replace(number, batch) and None)


def with_event_time(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("ts", F.col(column).cast("timestamp"))
