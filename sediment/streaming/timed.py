"""State with a type, a time to live and timers: objects of growing texts, replies, login windows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sediment.functions.formats import ObjectScan

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(rows: DataFrame, *keys: str):
    """rows by key. State of this kind needs the store that keeps it on disk; a query remembers the store it began with."""
    spark: SparkSession = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(*keys)


def _life(handle, name: str, schema: str, idle_seconds: int | None):
    """A value that goes when its key has had no rows for so long."""
    return handle.getValueState(name, schema, None if idle_seconds is None else 1000 * idle_seconds)


class _Objects(StatefulProcessor):
    """Keeps what is open of a text: its characters, how many were looked at, the depth, and whether in a string."""

    def __init__(self, idle_seconds: int | None):
        self.idle_seconds = idle_seconds

    def init(self, handle) -> None:
        self.open = _life(handle, "open", "tail string, scanned int, depth int, quoted boolean, escaped boolean, seen long", self.idle_seconds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        *held, seen = self.open.get() if self.open.exists() else ("", 0, 0, False, False, 0)
        scan = ObjectScan(*held)
        for row in sorted(rows, key=lambda r: r["seq"]):
            for text in scan.feed(row["piece"] or ""):
                yield Row(stream_id=key[0], n=seen, object=text)
                seen += 1
        self.open.update((scan.tail, scan.scanned, scan.depth, scan.quoted, scan.escaped, seen))

    def close(self) -> None:
        pass


def objects_of_streams(pieces: DataFrame, idle_seconds: int | None = 3600) -> DataFrame:
    """(stream_id, n, object): the whole JSON objects of growing texts, each once, from a stream (stream_id, seq, piece).

    Pieces are read in the order of seq within a batch, and batches in turn. Of a text only what is open
    stays in the state, and no character is looked at twice. An idle text is forgotten; a query with such
    a time to live runs on until it is stopped, also with the trigger availableNow (idle_seconds=None ends).
    """
    named = pieces.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.col("piece").cast("string").alias("piece"))
    mode = "None" if idle_seconds is None else "ProcessingTime"
    return _keyed(named, "stream_id").transformWithState(_Objects(idle_seconds), "stream_id string, n long, object string", "Append", mode)


class _Ends(StatefulProcessor):
    """Passes events on until the end mark; remembers only that it came."""

    def __init__(self, idle_seconds: int | None):
        self.idle_seconds = idle_seconds

    def init(self, handle) -> None:
        self.ended = _life(handle, "ended", "ended boolean", self.idle_seconds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.ended.exists():
            return
        for row in sorted(rows, key=lambda r: r["at"]):
            if (row["data"] or "").strip() == "[DONE]":
                self.ended.update((True,))
                return
            yield Row(stream_id=key[0], at=row["at"], data=row["data"], error=row["error"])

    def close(self) -> None:
        pass


def until_done(events: DataFrame, idle_seconds: int | None = 3600) -> DataFrame:
    """The events of each stream (stream_id, at, data, error) before its end mark, whatever follows it, in this batch or later ones."""
    named = events.select("stream_id", "at", "data", "error")
    mode = "None" if idle_seconds is None else "ProcessingTime"
    return _keyed(named, "stream_id").transformWithState(_Ends(idle_seconds), "stream_id string, at long, data string, error string", "Append", mode)


class _Logins(StatefulProcessor):
    def __init__(self, most: int, seconds: int):
        self.most, self.span = most, 1000 * seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "begun long, n long")

    def _close(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.window.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            at = int(row["at"].replace(tzinfo=dt.timezone.utc).timestamp() * 1000) if row["at"].tzinfo is None else int(row["at"].timestamp() * 1000)
            begun, n = self.window.get() if self.window.exists() else (at, 0)
            if n and at - begun >= self.span:
                self._close()
                begun, n = at, 0
            if not n:
                self.handle.registerTimer(at + self.span)
            n += 1
            yield Row(ip=key[0], seq=row["seq"], allowed=n <= self.most, attempts=n)
            if row["success"] and n <= self.most:
                self._close()
            else:
                self.window.update((begun, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The window's time is over: nothing of the address is kept."""
        _, n = self.window.get() if self.window.exists() else (0, 0)
        self.window.clear()
        yield Row(ip=key[0], seq=None, allowed=None, attempts=n)

    def close(self) -> None:
        pass


def login_windows(attempts: DataFrame, most: int = 5, seconds: int = 60, late: str = "30 seconds") -> DataFrame:
    """(ip, seq, allowed, attempts) for a stream of attempts (ip, seq, at timestamp, success): `most` in a window that begins with the first.

    A success clears the window; a timer closes it when the watermark has passed its end, with a row
    without seq that tells its attempts. Attempts later than the watermark are not judged.
    """
    named = attempts.select("ip", F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"), F.coalesce("success", F.lit(False)).alias("success"))
    return _keyed(named.withWatermark("at", late), "ip").transformWithState(_Logins(most, seconds), "ip string, seq long, allowed boolean, attempts long", "Append", "EventTime")
