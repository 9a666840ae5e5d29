"""Sharing sessions on a stream: order of event time, silent tabs, restart, late rows."""

import random
from datetime import datetime, timedelta

from maskwright.streaming import scan as stream_ops
from maskwright.streaming import sessions as stream_sessions

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, tab_id long, kind string, stream_id string"
DEAD = timedelta(hours=3)


def plain(events, mark):
    """Ended sessions of all events up to the mark."""
    out, tabs = [], {}
    for number, ts, tab, kind, stream in sorted((e for e in events if e[1] <= mark), key=lambda e: (e[1], e[0])):
        live, began, most, opens, seen = tabs.get(tab, (set(), None, 0, 0, None))
        if live and ts > seen + DEAD:
            out.append((tab, began, seen + DEAD, most, opens, True))
            live = set()
        if kind == "share_open" and stream not in live:
            began, most, opens = (began, most, opens) if live else (ts, 0, 0)
            live = live | {stream}
            most, opens = max(most, len(live)), opens + 1
        elif kind == "share_close" and stream in live:
            live = live - {stream}
            if not live:
                out.append((tab, began, ts, most, opens, False))
        tabs[tab] = (live, began, most, opens, ts)
    return sorted(out + [(tab, began, seen + DEAD, most, opens, True)
                         for tab, (live, began, most, opens, seen) in tabs.items() if live and seen + DEAD <= mark])


def write(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, base):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    with stream_sessions.keyed_state(spark):
        stream_ops.run_to_end(stream_sessions.ended_shares(stream, int(DEAD.total_seconds())), f"{base}/out", f"{base}/cp")
    return sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect())


def test_order_of_events_silence_and_restart(spark, tmp_path):
    rnd, at, events = random.Random(3), START, []
    for k in range(300):
        at += timedelta(seconds=rnd.choice([0, 1, 60, 600, 600, 20_000 if k % 40 == 0 else 30]), microseconds=rnd.randint(0, 999_999))
        events.append((k, at, rnd.choice([1, 1, 1, 2, 3]), rnd.choice(["share_open", "share_close", "focus"]), rnd.choice("ab")))
    arriving = sorted(events, key=lambda e: e[1] + timedelta(minutes=rnd.randint(0, 25)))
    for k in (0, 75):
        write(spark, f"{tmp_path}/in", arriving[k:k + 75])
    first = run(spark, tmp_path)
    assert first == plain(events, max(e[1] for e in arriving[:150]).replace(microsecond=0) - timedelta(hours=1))
    for k in (150, 225):
        write(spark, f"{tmp_path}/in", arriving[k:k + 75])
    got = run(spark, tmp_path)
    assert got == plain(events, max(e[1] for e in events) - timedelta(hours=1))
    assert len(got) > len(first) > 5 and {x[-1] for x in got} == {True, False}


def test_late_null_and_dead_tabs(spark, tmp_path):
    def event(k, hour, tab, kind, stream="s"):
        return k, None if hour is None else START + timedelta(hours=hour), tab, kind, stream
    write(spark, f"{tmp_path}/in", [event(1, 0, 1, "share_open"), event(2, 0, 2, "share_open", None), event(3, None, 1, "share_close"),
                                    event(4, 0, None, "share_open"), event(5, 1, 2, None)])
    write(spark, f"{tmp_path}/in", [event(6, 20, 9, "focus")])
    write(spark, f"{tmp_path}/in", [event(10, 21, 9, "focus")])  # the mark of the batch before decides what is late
    write(spark, f"{tmp_path}/in", [event(7, 0.5, 1, "share_close"), event(8, 20, 1, "share_close"), event(9, 30, 9, "focus")])
    hour = timedelta(hours=1)
    assert run(spark, tmp_path) == [(1, START, START + 3 * hour, 1, 1, True), (2, START, START + 4 * hour, 1, 1, True)]
