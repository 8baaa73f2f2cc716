"""Structured Streaming over an events table (event_id, ts, user_id, event_type, value).

Each function maps a streaming DataFrame to a streaming DataFrame and gives the same rows on a batch one, which is
how they are checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """ts as a timestamp with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, width: str = "1 hour", by: tuple = ("event_type",)) -> DataFrame:
    """Half-open windows: start, by, n, mean."""
    g = events.groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("start"), *by, "n", "mean")


def distinct_events(events: DataFrame, keys: tuple = ("user_id", "event_type", "ts")) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: start, end, user_id, n, total."""
    g = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n", "total")


class Totals(StatefulProcessor):
    """Count, sum and last time of a key's values; the key's state ends when none has come for `gap` milliseconds."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("totals", "n long, total double, last long")

    def _row(self, key, n: int, total: float, last: int, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key], "n": [n], "total": [total], "last": [pd.Timestamp(last, unit="ms")], "ended": [ended]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, last = self.state.get() if self.state.exists() else (0, 0.0, None)
        f = pd.concat(list(rows)).sort_values("ts")
        at = (f["ts"].to_numpy("datetime64[ms]")).astype("int64")
        values = f["value"].fillna(0.0).to_numpy(float)
        before = np.concatenate([[at[0] if last is None else last], at[:-1]])
        for part in np.split(np.arange(len(at)), np.flatnonzero(at - before > self.gap)):
            if not len(part):
                continue
            if last is not None and at[part[0]] - last > self.gap:  # a gap inside a batch ends the state as a timer would
                yield self._row(key[0], n, total, last, True)
                n, total, last = 0, 0.0, None
            n, total = n + len(part), total + float(values[part].sum())
            last = int(max(at[part[-1]], at[part[-1]] if last is None else last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.gap)
        self.state.update((n, total, last))
        yield self._row(key[0], n, total, last, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            n, total, last = self.state.get()
            self.state.clear()
            yield self._row(key[0], n, total, last, True)

    def close(self) -> None:
        pass


def running_totals(events: DataFrame, gap_minutes: float = 30 * 24 * 60, key: str = "user_id") -> DataFrame:
    """key, n, total, last, ended: totals so far of each key with new events, carried between triggers.

    `events` is a stream of `timed()` events. A key's state ends, with a row that says so, once the watermark is more than
    the gap past its last event, or when its next event comes later than that; then it starts again from 0, so that what
    is kept goes with the keys that are active and not with all that ever were. A null value adds to n only; rows without
    a time are left out, a null key is a key of its own. The stream needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    kind = events.schema[key].dataType.simpleString()
    d = events.filter("ts IS NOT NULL").select(key, "ts", "value").groupBy(key)
    return d.transformWithStateInPandas(Totals(key, int(gap_minutes * 60_000)), f"`{key}` {kind}, n long, total double, last timestamp, ended boolean", "update", "EventTime")


def daily(events: DataFrame, by: tuple = ("event_type",)) -> DataFrame:
    """Half-open day windows: start, by, n, mean."""
    return windowed(events, "1 day", by)


def to_day_files(events: DataFrame, folder: str, checkpoint: str):
    """Starts a query that adds events to a folder with one partition for each day (day=YYYY-MM-DD) and ends when it has
    read what is there. Started again with the same checkpoint it goes on where it stopped, without rows twice."""
    d = events.withColumn("day", F.to_date("ts"))
    return d.writeStream.format("parquet").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
