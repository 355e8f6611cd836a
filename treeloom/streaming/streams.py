"""Structured Streaming over event and mutation logs.

Stateless steps are stream-static joins; per-document state (focus, toggles,
timers) is in transformWithState, keyed by document, so state is spread over the
cluster and kept by the checkpointed store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_log(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def _with_zone(df: DataFrame, ts: str) -> DataFrame:
    """Event time needs a timestamp of the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] == "timestamp_ntz" else df


class FocusProcessor(StatefulProcessor):
    """Keeps each document's focused node; gives blur, focusout, focus and focusin."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "node_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        was = self.active.get()[0] if self.active.exists() else None
        out = []
        for request, target in zip(batch["request_id"], batch["target_id"]):
            now = None if pd.isna(target) else int(target)
            if now == was:
                continue
            if was is not None:
                out += [(key[0], request, 1, "blur", was, now), (key[0], request, 2, "focusout", was, now)]
            if now is not None:
                out += [(key[0], request, 3, "focus", now, was), (key[0], request, 4, "focusin", now, was)]
            was = now
        if was is None:
            self.active.clear()
        else:
            self.active.update((was,))
        yield pd.DataFrame(out, columns=["doc_id", "request_id", "ord", "type", "target_id", "related_id"]).astype({"target_id": "Int64", "related_id": "Int64"})

    def close(self) -> None:
        pass


FOCUS = "doc_id long, request_id long, ord int, type string, target_id long, related_id long"


def focus_stream(requests: DataFrame) -> DataFrame:
    """focus_events over a stream (doc_id, request_id, target_id, ts)."""
    return requests.groupBy("doc_id").transformWithStateInPandas(FocusProcessor(), FOCUS, "Append", "none")


class ToggleProcessor(StatefulProcessor):
    """Counts clicks of a checkbox; gives its checkedness after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clicks = handle.getValueState("clicks", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = sum(len(r) for r in rows) + (self.clicks.get()[0] if self.clicks.exists() else 0)
        self.clicks.update((n,))
        yield pd.DataFrame([(key[0], key[1], n % 2 == 1)], columns=["doc_id", "node_id", "toggled"])

    def close(self) -> None:
        pass


def toggle_stream(clicks: DataFrame) -> DataFrame:
    """(doc_id, node_id, toggled) of a stream of clicks (doc_id, node_id)."""
    return clicks.groupBy("doc_id", "node_id").transformWithStateInPandas(ToggleProcessor(), "doc_id long, node_id long, toggled boolean", "Update", "none")


class TimerProcessor(StatefulProcessor):
    """setTimeout, setInterval and clear over event time.

    Rows: op (set, interval, clear), timer_id, delay_ms, ts.  A timer that is due
    gives a row; an interval is set again.  Tasks queued by one batch run in order
    of their due times within it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timers = handle.getMapState("timers", "timer_id long", "due long, every long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for r in pd.concat(list(rows)).sort_values(["ts", "timer_id"]).itertuples():
            name = (int(r.timer_id),)
            if self.timers.containsKey(name):
                self.handle.deleteTimer(self.timers.getValue(name)[0])
                self.timers.removeKey(name)
            if r.op != "clear":
                due = int(r.ts.timestamp() * 1000) + max(int(r.delay_ms), 1)
                self.timers.updateValue(name, (due, int(r.delay_ms) if r.op == "interval" else 0))
                self.handle.registerTimer(due)
        yield pd.DataFrame({"doc_id": [], "timer_id": [], "fired_ms": []}).astype("int64")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for name, (due, every) in list(self.timers.iterator()):
            if due <= at:
                out.append((key[0], name[0], due))
                if every:
                    self.timers.updateValue(name, (due + every, every))
                    self.handle.registerTimer(due + every)
                else:
                    self.timers.removeKey(name)
        yield pd.DataFrame(sorted(out, key=lambda r: (r[2], r[1])), columns=["doc_id", "timer_id", "fired_ms"])

    def close(self) -> None:
        pass


def timer_stream(rows: DataFrame, *, late: str = "0 seconds") -> DataFrame:
    """(doc_id, timer_id, fired_ms) of a stream (doc_id, op, timer_id, delay_ms, ts)."""
    return _with_zone(rows, "ts").withWatermark("ts", late).groupBy("doc_id").transformWithStateInPandas(TimerProcessor(), "doc_id long, timer_id long, fired_ms long", "Append", "EventTime")


def timers_due(rows: DataFrame, until_ms: int) -> DataFrame:
    """The batch form of timer_stream up to a time: (doc_id, timer_id, fired_ms)."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id", "timer_id").orderBy("ts")
    rows = _with_zone(rows, "ts")
    r = rows.withColumn("_until", F.coalesce(F.unix_millis(F.lead("ts").over(order)), F.lit(until_ms + 1))).filter("op <> 'clear'")
    start = F.unix_millis("ts") + F.greatest(F.col("delay_ms"), F.lit(1))
    last = F.least(F.col("_until") - 1, F.lit(until_ms))
    step = F.greatest(F.col("delay_ms"), F.lit(1)).cast("long")
    due = F.when(start > last, F.array().cast("array<bigint>")).when(F.col("op") == "interval", F.sequence(start, last, step)).otherwise(F.array(start))
    return r.select("doc_id", "timer_id", F.explode(due).alias("fired_ms"))


def observe(mutations: DataFrame, nodes: DataFrame, observations: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str):
    """Start delivery of mutation records: each micro-batch is a task, an observer gets its records once in it."""
    from ..operators.events import route_records

    def task(batch: DataFrame, batch_id: int) -> None:
        records = route_records(nodes, batch, observations)
        grouped = records.groupBy("observer_id").agg(F.sort_array(F.collect_list(F.struct("seq", "type", "doc_id", "target_id", "attribute_name", "old_value"))).alias("records"))
        deliver(grouped, batch_id)

    return mutations.writeStream.foreachBatch(task).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A log without repeats that come within ``late`` of each other."""
    return _with_zone(stream, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, width: str = "1 hour", ts: str = "ts", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Events of each kind by window, late ones up to the watermark included."""
    return _with_zone(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
