"""Stateful streams over control events."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .scan import WATERMARK

CLOSED = "tab_id bigint, started_at timestamp, ended_at timestamp, max_streams int, opens int"
STATE = "streams array<string>, started_at timestamp, max_streams int, opens int"


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Open streams of one tab; a row for every session that ends in this batch."""
    streams, began, most, opens = state.get if state.exists else ([], None, 0, 0)
    live = set(streams)
    closed = []
    # A micro-batch bounds what one tab brings; its rows arrive unordered.
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for ts, kind, stream in zip(rows["ts"], rows["kind"], rows["stream_id"]):
        if kind == "share_open" and stream not in live:
            began = began if live else ts
            live.add(stream)
            most, opens = max(most, len(live)), opens + 1
        elif kind == "share_close" and stream in live:
            live.remove(stream)
            if not live:
                closed.append((key[0], began, ts, most, opens))
                began, most, opens = None, 0, 0
    state.update((sorted(live), began, most, opens))
    yield pd.DataFrame(closed, columns=["tab_id", "started_at", "ended_at", "max_streams", "opens"])


def closed_shares(events: DataFrame) -> DataFrame:
    """Finished sharing sessions, emitted when the last stream of a tab closes."""
    shares = events.where(F.col("kind").isin("share_open", "share_close"))
    return shares.groupBy("tab_id").applyInPandasWithState(
        _advance, CLOSED, STATE, "append", GroupStateTimeout.NoTimeout)


ENDED = "tab_id bigint, began bigint, ended bigint, max_streams int, opens int, expired boolean"


class _Shares(StatefulProcessor):
    """Open streams of a tab, in the order of event time, with the end of tabs that fall silent.

    Rows wait until the watermark has passed them, so their order does not
    depend on the batch that brought them. Times are microseconds.
    """

    def __init__(self, dead_after: int):
        self.dead_after = dead_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, event_id bigint, kind string, stream_id string")
        self.streams = handle.getMapState("streams", "stream_id string", "opened bigint")
        self.session = handle.getValueState("session", "began bigint, most int, opens int, seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = [(int(us), int(number), kind, None if pd.isna(stream) else stream) for us, number, kind, stream
                   in zip(batch["us"], batch["event_id"], batch["kind"], batch["stream_id"])]
            self.waiting.appendList(new)
            least = min(row[0] for row in new)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame([], columns=["tab_id", "began", "ended", "max_streams", "opens", "expired"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        began, most, opens, seen = self.session.get() if self.session.exists() else (None, 0, 0, None)
        live = {k[0] for k, _ in self.streams.iterator()} if began is not None else set()
        ended = []

        def expire() -> None:
            ended.append((key[0], began, seen + self.dead_after, most, opens, True))
            live.clear()
        for us, _, kind, stream in due:
            if live and us > seen + self.dead_after:
                expire()
            seen = us
            if kind == "share_open" and stream not in live:
                began, most, opens = (began, most, opens) if live else (us, 0, 0)
                live.add(stream)
                most, opens = max(most, len(live)), opens + 1
            elif kind == "share_close" and stream in live:
                live.remove(stream)
                if not live:
                    ended.append((key[0], began, us, most, opens, False))
        if live and seen + self.dead_after <= mark:
            expire()
        self._keep(rest, live, (began, most, opens, seen))
        yield pd.DataFrame(ended, columns=["tab_id", "began", "ended", "max_streams", "opens", "expired"])

    def _keep(self, rest: list, live: set, session: tuple) -> None:
        """State and timers for what is still to come; a tab that neither shares nor waits has none."""
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()
        self.streams.clear()
        if not live:
            self.session.clear()
            return
        for stream in live:
            self.streams.updateValue((stream,), (session[0],))
        self.session.update(session)
        self.handle.registerTimer(-(-(session[3] + self.dead_after) // 1000))

    def close(self) -> None:
        pass


def ended_shares(events: DataFrame, dead_after_seconds: int) -> DataFrame:
    """Sharing sessions that ended: by the close of the last stream, or ``dead_after_seconds`` after a tab's last event.

    ``events(event_id, ts, tab_id, kind, stream_id)``, any kind being a sign of
    life. Rows later than the watermark are dropped; all others count in the
    order of (ts, event_id), whichever batch brings them. A dead tab leaves no
    state; a row without a time or tab plays no part. Start the query within
    ``keyed_state``.
    """
    rows = events.where(F.col("ts").isNotNull() & F.col("tab_id").isNotNull()).withWatermark("ts", WATERMARK).select(
        "tab_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("bigint").alias("event_id"), "kind", "stream_id")
    ended = rows.groupBy("tab_id").transformWithStateInPandas(
        _Shares(dead_after_seconds * 1_000_000), ENDED, "append", "EventTime")
    return ended.select("tab_id", F.timestamp_micros("began").alias("started_at"),
                        F.timestamp_micros("ended").alias("ended_at"), "max_streams", "opens", "expired")


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started in here keep their state in RocksDB, which several states and timers of a key need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def activity(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Stretches of activity per tab: a longer silence ends one. Late rows beyond the watermark are dropped."""
    return events.withWatermark("ts", WATERMARK).groupBy(
        "tab_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(
        F.count("*").alias("events")).select(
        "tab_id", F.col("w.start").alias("began"), F.col("w.end").alias("idle_at"), "events")


def findings_per_window(findings: DataFrame, length: str = "1 hour") -> DataFrame:
    """Findings per tumbling window and detector; ``findings(ts, detector)``."""
    return findings.withWatermark("ts", WATERMARK).groupBy(
        F.window("ts", length).alias("w"), "detector").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("began"), "detector", "n")
