"""Activity per key as keyed state that expires: first and last event, number of events, with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from marginalia.sources import snapshots
from marginalia.streaming import tables

#: The state store that transformWithState needs; a session sets it before a stream with expiring state starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Activity(StatefulProcessor):
    """One row of state per key; a timer at the last event plus the time to live clears it."""

    def __init__(self, keys: list[str], ttl_seconds: int):
        self.keys, self.ttl = keys, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("activity", StructType([StructField("first", LongType()), StructField("last", LongType()), StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, n = self.state.get() if self.state.exists() else (None, None, 0)
        for part in rows:
            us = part["ts"].astype("datetime64[us]").astype("int64")
            low, high = int(us.min()), int(us.max())
            first, last, n = low if first is None else min(first, low), high if last is None else max(last, high), n + len(part)
        self.state.update((first, last, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.ttl + 1)
        yield self._row(key, first, last, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, n = self.state.get()
        self.state.clear()
        yield self._row(key, first, last, n, True)

    def _row(self, key, first: int, last: int, n: int, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "first_seen_at": [pd.Timestamp(first, unit="us")], "last_used_at": [pd.Timestamp(last, unit="us")], "n": [n], "expired": [expired]})

    def close(self) -> None:
        pass


def run_activity(events: DataFrame, keys: list[str], root: str, ttl_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """First and last time and number of events of every live key of a stream with a ``ts`` column; rows without ``ts`` or a key take no part.

    A key whose last event lies more than ``ttl_seconds`` before the watermark (the newest event less ``delay``) leaves the state and the table; a later
    event begins it anew. So the state holds keys of the last ``ttl_seconds`` alone, however long the stream runs. ``root`` holds state and results, a
    later call goes on where this one ended (see ``tables.run_aggregate``). An input without rows gives an empty table.
    """
    spark = events.sparkSession
    spark.conf.set(*STATE_STORE)
    kinds = dict(events.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", first_seen_at TIMESTAMP, last_used_at TIMESTAMP, n BIGINT, expired BOOLEAN"
    known = events.select(*keys, F.col("ts").cast(TimestampType()).alias("ts")).dropna()
    states = known.withWatermark("ts", delay).groupBy(*keys).transformWithStateInPandas(_Activity(keys, ttl_seconds), schema, "Update", "EventTime")

    def save(batch: DataFrame, number: int) -> None:
        if len(tables._deltas(spark, root)) >= tables.FOLD:
            tables._fold(spark, root, keys, schema, "expired")
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    states.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    tables._fold(spark, root, keys, schema, "expired")
    return snapshots.read(spark, f"{root}/latest", f"{schema}, batch BIGINT").drop("batch", "expired")
