"""Streams that keep state: sessions with timers, sessions by window, and joins of two streams.

All of them hold state for what the watermark hasn't passed and drop it after
that, so state is bounded by the rows of that time, not by the stream.  A query
restarted from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: The store that timers need; a session sets it before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def window_sessions(events: DataFrame, key: str, time: str, gap: timedelta, value: str, lateness: timedelta | None = None) -> DataFrame:
    """``key, start, end, n, total`` by session windows, of a table or, with ``lateness``, of a stream; ``end`` is the last event's time."""
    source = events.withWatermark(time, f"{lateness.total_seconds():.6f} seconds") if lateness is not None else events
    # a window ends before its bound, and the bound itself still belongs to a session
    length = f"{gap // timedelta(microseconds=1) + 1} microseconds"
    made = source.groupBy(F.session_window(time, length).alias("w"), key).agg(F.max(time).alias("end"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return made.select(key, F.col("w.start").alias("start"), "end", "n", "total")


class _Sessions(StatefulProcessor):
    """The open sessions of a key, closed by timers once the watermark is a gap behind their end."""

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "a array<bigint>, b array<bigint>, n array<bigint>, total array<double>")

    def _held(self) -> list[tuple]:
        return list(zip(*self.open.get(), strict=True)) if self.open.exists() else []

    def _hold(self, found: list[tuple]) -> None:
        if found:
            self.open.update(tuple(list(x) for x in zip(*found, strict=True)))
        else:
            self.open.clear()

    def _due(self, end: int) -> int:
        return (end + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        merged: list[tuple] = []
        for a, b, n, total in sorted([*self._held(), *((r["t"], r["t"], 1, r["v"]) for r in rows)], key=lambda s: s[:2]):
            if merged and a - merged[-1][1] <= self.gap:
                x = merged[-1]
                both = None if x[3] is None and total is None else (x[3] or 0.0) + (total or 0.0)
                merged[-1] = (x[0], max(x[1], b), x[2] + n, both)
            else:
                merged.append((a, b, n, total))
        self._hold(merged)
        for _, end, _, _ in merged:
            self.handle.registerTimer(self._due(end))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        self._hold([s for s in held if self._due(s[1]) > now])
        for a, b, n, total in held:
            if self._due(b) <= now:
                yield Row(k=key[0], a=a, b=b, n=n, total=total)

    def close(self) -> None:
        pass


def timed_sessions(events: DataFrame, key: str, time: str, gap: timedelta, value: str, lateness: timedelta) -> DataFrame:
    """``key, start, end, n, total`` of a stream, each session once, when no event can reach it any more.

    A stateful processor keeps a key's open sessions; needs ``STATE_STORE`` and append mode.
    Events without key or time are left out.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, f"{lateness.total_seconds():.6f} seconds")
    rows = rows.select(F.col(key).alias("k"), F.col(time).alias("at"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("v"))
    kind = events.schema[key].dataType.simpleString()
    made = rows.groupBy("k").transformWithState(
        _Sessions(gap // timedelta(microseconds=1)), f"k {kind}, a bigint, b bigint, n bigint, total double", "Append", "EventTime"
    )
    return made.select(F.col("k").alias(key), F.timestamp_micros("a").alias("start"), F.timestamp_micros("b").alias("end"), "n", "total")


def joined_streams(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, within: timedelta, lateness: timedelta, how: str = "inner") -> DataFrame:
    """Rows of two streams with one key whose times are at most ``within`` apart, the left side's columns first.

    Both sides have watermarks, so each side's rows are kept only while the other
    may still bring a partner; with ``how`` ``left_outer`` a row without one comes
    out after that.  The right side's columns get the suffix ``_right`` where names clash.
    """
    late, reach = f"{lateness.total_seconds():.6f} seconds", F.expr(f"INTERVAL '{within.total_seconds():.6f}' SECOND")
    renamed = {c: f"{c}_right" for c in right.columns if c in left.columns}
    a, b = left.withWatermark(left_time, late), right.withColumnsRenamed(renamed).withWatermark(renamed.get(right_time, right_time), late)
    other = F.col(renamed.get(right_time, right_time))
    near = (other >= F.col(left_time) - reach) & (other <= F.col(left_time) + reach)
    return a.join(b, (F.col(on) == F.col(renamed.get(on, on))) & near, how)


def run_to_table(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a Parquet table, then stops; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
