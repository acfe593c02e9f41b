"""Expiry and change notifications as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

EVENTS = StructType([StructField("key", StringType()), StructField("event", StringType()), StructField("at_ms", LongType())])
_STATE = StructType([StructField("expire_at_ms", LongType()), StructField("seq", LongType())])


class Expirer(StatefulProcessor):
    """Keeps each key's deadline; an event-time timer fires at it and reports ``expired``.

    Writes of one batch count in the order of ``seq``. A write without a deadline (SET, PERSIST) takes the timer away; DEL reports ``del`` where the key was known.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("deadline", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("seq")
        out = []
        held = self.state.get()[0] if self.state.exists() else None
        known, start = self.state.exists(), held
        for cmd, at in zip(frame["cmd"], frame["expire_at_ms"]):
            if cmd == "DEL":
                if known:
                    out.append((key[0], "del", None))
                held, known = None, False
            elif cmd == "PERSIST":
                if known and held is not None:
                    out.append((key[0], "persist", None))
                    held = None
            else:
                held, known = (None if pd.isna(at) else int(at)), True
                out.append((key[0], "set", held))
        if start is not None and start != held:
            self.handle.deleteTimer(start)
        if known:
            self.state.update((held, int(frame["seq"].iloc[-1])))
            if held is not None and start != held:
                self.handle.registerTimer(held)
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=["key", "event", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.state.clear()
        yield pd.DataFrame([(key[0], "expired", at)], columns=["key", "event", "at_ms"])

    def close(self) -> None:
        pass


def expiring(log: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """A stream of (key, event, at_ms) from a stream of (key, seq, ts, cmd, expire_at_ms).

    Deadlines are met in event time: a key expires once the watermark (the latest ``ts`` less ``lateness``) has passed its deadline. The session needs the RocksDB state store.
    """
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return rows.groupBy("key").transformWithStateInPandas(Expirer(), EVENTS, "append", "EventTime")


def channel_counts(notifications: DataFrame, every: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Messages by channel and window of a stream of (ts, channel, message)."""
    return notifications.withWatermark("ts", lateness).groupBy(F.window("ts", every), "channel").agg(F.count("*").alias("n"))


__all__ = ["EVENTS", "Expirer", "channel_counts", "expiring"]
