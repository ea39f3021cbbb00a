"""Incremental results: running totals of each key, kept in state, with timers that say when a key has gone quiet.

A micro-batch gives a row for each key that it touches: the totals so far and a version. The order of rows does not matter,
as totals add up: the last version of each key is what a batch over the same rows gives. Time is that of the rows: once the
watermark, the latest time less the delay, is `idle` seconds past a key's last row, the key gives one row more that marks it quiet, and
`keep` seconds past it its state goes. Rows later than the delay are dropped by the stream, so the delay says how late rows may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "version long, n long, total double, last long"
#: The state store that timers and expiry need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Progress(StatefulProcessor):
    """Rows key, at, micros, value; see `progress`."""

    def __init__(self, idle: float, keep: float):
        self.idle, self.keep = int(idle * 1000), int(keep * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", STATE)

    def _row(self, key, state: tuple, quiet: bool) -> pd.DataFrame:
        version, n, total, last = state
        return pd.DataFrame({"key": [key[0]], "version": [version], "n": [n], "total": [total], "last": [last], "quiet": [quiet]})

    def _wait(self, last: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for after in {self.idle, self.keep}:
            self.handle.registerTimer(last // 1000 + after)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, n, total, last = self.totals.get() if self.totals.exists() else (0, 0, 0.0, 0)
        for batch in rows:
            n += len(batch)
            total += float(batch["value"].sum())  # nulls add nothing
            last = max(last, int(batch["micros"].max()))
        state = (version + 1, n, total, last)
        self.totals.update(state)
        self._wait(last)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.totals.exists():
            return
        version, n, total, last = self.totals.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= last // 1000 + self.keep:
            self.totals.clear()
            return
        state = (version + 1, n, total, last)
        self.totals.update(state)
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def progress(stream: DataFrame, key: str, at: str, value: str, delay: str = "1 day", idle: float = 3600, keep: float = 7 * 86400) -> DataFrame:
    """key, version, n, total, last (microseconds), quiet: the rows of each micro-batch. Rows without a time take no part.

    The session's state store must be PROVIDER's.
    """
    slim = stream.where(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), F.col(value).cast("double").alias("value"))
    out = f"key {dict(stream.dtypes)[key]}, version long, n long, total double, last long, quiet boolean"
    return slim.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(Progress(idle, keep), outputStructType=out, outputMode="Update", timeMode="EventTime")


def latest(updates: DataFrame) -> DataFrame:
    """The last version of each key: key, n, total, last."""
    newest = F.max(F.struct("version", "n", "total", "last")).alias("s")
    return updates.groupBy("key").agg(newest).select("key", "s.n", "s.total", "s.last")


def totals(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """What the stream ends with, by one batch: key, n, total, last."""
    return df.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("total"), F.max(F.unix_micros(F.col(at).cast("timestamp"))).alias("last"))


def run(spark: SparkSession, updates: DataFrame, folder: str) -> StreamingQuery:
    """Everything there is, then stop: each micro-batch's rows as a folder of Parquet that a retry overwrites."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    return updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
