"""Stateful streams that stand alone: rows are put in order behind a watermark, ends are set by timers.

Rows come as they are, late, repeated or missing some; no row knows its number or how many
there are. The state of a key is an ordering buffer (a list of rows, read and written in bulk) and what the
fold remembers. When the watermark has passed a row's time, no row before it can come any more: it is
taken out, repeated rows once, and folded. A timer at the first time still waited for
brings the key back when no row of its own arrives: that is how the last part of a day
gets out. Rows behind the watermark are dropped, by Spark and here.

State holds the rows of one delay and a fixed record a key, in typed columns. It needs the RocksDB
state store provider (``with_state_store``). A key is a state of one task: a camera's day.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from condense.operators.segments import DAY, SEGMENT_COLUMNS
from condense.session import ship

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MS = 1_000


def with_state_store(spark: SparkSession) -> None:
    """Choose the RocksDB state store, unless the session names one."""
    if "spark.sql.streaming.stateStore.providerClass" not in spark.conf.getAll:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)


class OrderedRelease(StatefulProcessor):
    """Releases the rows of a key in order as the watermark passes them.

    ``at_us`` (microseconds; a name may not begin with an underscore here) and ``identity`` columns order the rows. Subclasses fold:
    ``start`` gives the record of a new key, ``step`` takes a released row, ``closing`` tells the event time
    (microseconds) from which the record can't change any more and ``close`` gives out what it holds.
    """

    memory_schema: T.StructType

    def __init__(self, keys: list[str], identity: list[str], schema: T.StructType, output: T.StructType, forget_after: int):
        self.keys, self.identity, self.forget_after = keys, identity, forget_after
        self.columns = [f.name for f in schema.fields if f.name not in {*keys, "at_us"}]
        self.row_schema = T.StructType([T.StructField("at_us", T.LongType()), *[schema[c] for c in self.columns]])
        self.places = [1 + self.columns.index(c) for c in identity]
        self.names = [f.name for f in output.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", self.row_schema)
        self.memory = handle.getValueState("memory", self.memory_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * MS
        new: list[tuple] = []
        for pdf in rows:
            if pdf.empty:  # a frame without rows has no columns either
                continue
            values = pdf[["at_us", *self.columns]].astype(object)
            new += [tuple(r) for r in values.where(values.notna(), None).itertuples(index=False) if r[0] > passed]
        if new:
            self.buffer.appendList(new)
        yield self._release(key, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key, timerValues.getCurrentWatermarkInMs() * MS)

    def _release(self, key: tuple, passed: int) -> pd.DataFrame:
        held = [tuple(r) for r in self.buffer.get()] if self.buffer.exists() else []
        due = sorted((r for r in held if r[0] <= passed), key=self._place)
        waiting = [r for r in held if r[0] > passed]
        memory = list(self.memory.get()) if self.memory.exists() else self.start()
        out: list[tuple] = []
        before = None
        for row in due:
            if (place := self._place(row)) != before:
                out += self.step(memory, dict(zip(self.columns, row[1:])), row[0])
            before = place
        if due and waiting:
            self.buffer.put(waiting)
        elif due:
            self.buffer.clear()
        if (end := self.closing(memory)) is not None and end <= passed:
            out += self.close(memory)
            end = None
        times = ([min(r[0] for r in waiting)] if waiting else []) + ([end] if end is not None else [])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not times:  # nothing is held: the record itself goes after a while
            times = [memory[0] + self.forget_after]
            if times[0] <= passed:
                self.memory.clear()
                return self._rows(key, out)
        self.memory.update(tuple(memory))
        self.handle.registerTimer(-(-min(times) // MS))
        return self._rows(key, out)

    def _place(self, row: tuple) -> tuple:
        return (row[0], *[(row[i] is not None, row[i]) for i in self.places])

    def _rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([tuple(key) + tuple(o) for o in out], columns=self.names)

    def start(self) -> list:
        raise NotImplementedError

    def step(self, memory: list, row: dict, at: int) -> list[tuple]:
        raise NotImplementedError

    def closing(self, memory: list) -> int | None:
        raise NotImplementedError

    def close(self, memory: list | None = None) -> list[tuple] | None:
        """With a record: what it gives out. Without: the end of the task, where nothing is to be done."""
        raise NotImplementedError


class MergeSegments(OrderedRelease):
    """Joins neighbouring segments of equal state; the open one is in the record."""

    memory_schema = T.StructType([
        T.StructField("last_at", T.LongType()),
        T.StructField("released", T.LongType()),
        T.StructField("open", T.BooleanType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ends_at", T.LongType()),
        T.StructField("start_time", T.DoubleType()),
        T.StructField("end_time", T.DoubleType()),
        T.StructField("state", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("file_start_offset", T.DoubleType()),
        T.StructField("max_energy", T.DoubleType()),
    ])
    parts = list(SEGMENT_COLUMNS)

    def __init__(self, *args, tolerance: float):
        super().__init__(*args)
        self.tolerance = tolerance

    def start(self) -> list:
        return [0, 0, False, 0, 0, *[None] * len(self.parts)]

    def step(self, memory: list, row: dict, at: int) -> list[tuple]:
        held = dict(zip(self.parts, memory[5:]))
        made: list[tuple] = []
        if memory[2] and held["state"] == row["state"] and row["start_time"] - held["end_time"] <= self.tolerance:
            held["end_time"] = row["end_time"]
            held["max_energy"] = max(held["max_energy"], row["max_energy"])
        else:
            made = self.close(memory)
            held = {c: row[c] for c in self.parts}
            memory[2:4] = [True, memory[1]]
        # in event time: a later row can join if it starts at most the tolerance after this end
        memory[4] = at + round((row["end_time"] - row["start_time"] + self.tolerance) * 1e6) + MS
        memory[5:] = [held[c] for c in self.parts]
        memory[:2] = [at, memory[1] + 1]
        return made

    def closing(self, memory: list) -> int | None:
        return memory[4] if memory[2] else None

    def close(self, memory: list | None = None) -> list[tuple] | None:
        if memory is None:
            return None
        made = [(memory[3], *memory[5:])] if memory[2] else []
        memory[2] = False
        return made


class FillBatches(OrderedRelease):
    """Puts finished clips into batches of ``per_batch``; a batch that no clip joins in time is given out as it is."""

    memory_schema = T.StructType([
        T.StructField("last_at", T.LongType()),
        T.StructField("number", T.LongType()),
        T.StructField("paths", T.ArrayType(T.StringType())),
    ])

    def __init__(self, *args, per_batch: int, patience: int):
        super().__init__(*args)
        self.per_batch, self.patience = per_batch, patience

    def start(self) -> list:
        return [0, 0, []]

    def step(self, memory: list, row: dict, at: int) -> list[tuple]:
        memory[0] = at
        memory[2] = [*memory[2], row["path"]]
        return self.close(memory) if len(memory[2]) == self.per_batch else []

    def closing(self, memory: list) -> int | None:
        return memory[0] + self.patience if len(memory[2]) else None

    def close(self, memory: list | None = None) -> list[tuple] | None:
        if memory is None:
            return None
        made = [(path, memory[1]) for path in memory[2]]
        memory[1:] = [memory[1] + bool(made), []]
        return made


def _released(
    stream: DataFrame, event_time: str, delay: str, identity: list[str], output: T.StructType, make, forget_days: float
) -> DataFrame:
    ship(stream.sparkSession)
    with_state_store(stream.sparkSession)
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    rows = timed.withColumn("at_us", F.unix_micros(event_time))
    schema = T.StructType([f for f in rows.schema.fields if f.name != event_time])
    processor = make(list(DAY), identity, schema, output, int(forget_days * 86_400_000_000))
    return rows.groupBy(*DAY).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode="eventTime"
    )


def merge_stream(
    segments: DataFrame, event_time: str = "event_time", delay: str = "2 days", tolerance: float = 0.5, forget_days: float = 7.0
) -> DataFrame:
    """Merge neighbouring segments of a day as they arrive.

    ``segments`` has the day, ``event_time`` (when the segment starts), the segment columns, ``file_start_time`` and
    ``seq_in_file``. A merged segment is given out when its successor doesn't join, or when the
    watermark has passed the time until which one could. ``seq`` counts the segments
    of the day as released, from 0; after ``forget_days`` without any it starts anew.
    """
    identity = ["file_start_time", "source_file", "seq_in_file"]
    output = T.StructType([segments.schema[k] for k in DAY] + [T.StructField("seq", T.LongType())] + [segments.schema[c] for c in SEGMENT_COLUMNS])
    make = lambda *args: MergeSegments(*args, tolerance=tolerance)
    return _released(segments, event_time, delay, identity, output, make, forget_days)


def batch_stream(
    clips: DataFrame,
    event_time: str = "done_at",
    delay: str = "2 days",
    per_batch: int = 4,
    patience_hours: float = 24.0,
    forget_days: float = 7.0,
) -> DataFrame:
    """Put finished clips of a day into batches of ``per_batch`` in order of completion.

    ``clips`` has the day, ``path`` and ``event_time``, when the clip was finished. A smaller batch is given out when no clip has joined
    it for ``patience_hours`` of event time. A path reported again before it is released counts once.
    """
    output = T.StructType([*[clips.schema[k] for k in DAY], clips.schema["path"], T.StructField("batch_idx", T.LongType())])
    make = lambda *args: FillBatches(*args, per_batch=per_batch, patience=int(patience_hours * 3_600_000_000))
    return _released(clips, event_time, delay, ["path"], output, make, forget_days)
