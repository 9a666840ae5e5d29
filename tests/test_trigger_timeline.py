"""Evaluations over time and their notices, against a plain simulation."""

import random
from datetime import datetime, timedelta

import pytest

from maskwright.operators import sessions as S

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, tab_id long, host string, kind string, stream_id string, trigger string"
SETTINGS = "tab_id long, idle_enabled boolean, tab_switch_enabled boolean, share_enabled boolean, enabled boolean"
TRIGGERS = ("idle", "tab_switch", "screen_share")
LIMIT = timedelta(seconds=60)


def simulate(events, settings):
    """All evaluations in order: (event_id, tab, seq, phase, tab phase, idle, tab, share, share suspended, master)."""
    events = sorted(events, key=lambda e: (e[1], e[0]))
    steps = []
    for k, e in enumerate(events):
        steps.append((e[1], e[0], 0, e))
        following = next((x[1] for x in events[k + 1:] if x[2] == e[2]), None)
        if e[4] != "lock" and (following is None or following > e[1] + LIMIT):
            steps.append((e[1] + LIMIT, e[0], 1, e))
    streams, listed, off, phase, master, out = {}, set(), set(), {}, None, []
    for at, number, seq, (_, _, tab, host, kind, stream, trigger) in sorted(steps, key=lambda s: s[:3]):
        if seq == 0:
            mine = streams.setdefault(tab, set())
            if kind == "share_open":
                mine.add(stream)
                listed = {x for x in listed if x[:2] != ("screen_share", "tab")}
            elif kind == "share_close" and stream in mine:
                mine.remove(stream)
                if not any(streams.values()):
                    off.discard("screen_share")
            elif kind in ("ignore_tab", "ignore_site"):
                listed.add((trigger, kind[7:], tab if kind == "ignore_tab" else host))
            elif kind in ("unignore_tab", "unignore_site"):
                listed.discard((trigger, kind[9:], tab if kind == "unignore_tab" else host))
            elif kind == "suspend":
                off.add(trigger)
            elif kind == "resume":
                off.discard(trigger)
            elif kind in ("enable", "disable"):
                master = kind == "enable"
            elif kind in ("focus", "hide", "lock"):
                phase[tab] = "off" if kind == "focus" else "fired"
        if tab not in settings:
            continue
        idle, switch, share = map(bool, settings[tab][:3])
        on = settings[tab][3] is not False if master is None else master
        idle_phase = "idle" if seq else "locked" if kind == "lock" else "active"

        def acts(name, wanted):
            return on and wanted and name not in off and (name, "tab", tab) not in listed and (name, "site", host) not in listed
        sharing = any(streams.values())
        out.append((number, tab, seq, idle_phase, phase.get(tab, "off"), acts("idle", idle) and idle_phase != "active",
                    acts("tab_switch", switch) and phase.get(tab) == "fired",
                    acts("screen_share", share) and sharing and not streams.get(tab),
                    sharing and "screen_share" in off, on))
    return out


def notices(evaluations):
    out, last, seeded = [], {}, set()
    for number, tab, seq, idle_phase, tab_phase, idle, switch, share, suspended, on in evaluations:
        was_idle, was_tab, was_share = last.get(tab, (None, None, False))
        if not on:
            out += [(number, tab, "share_dismiss")] * was_share
        elif tab in seeded:
            if idle and idle_phase != was_idle and not share:
                out.append((number, tab, "idle_show"))
            elif not idle and was_idle != "active" and idle_phase == "active" and not share:
                out.append((number, tab, "idle_dismiss"))
            if switch and tab_phase != was_tab:
                out.append((number, tab, "tab_show"))
            if share and not was_share:
                out.append((number, tab, "share_show"))
            if was_share and not share:
                out += [(number, tab, "share_dismiss")] + [(number, tab, "share_suspended")] * suspended
        seeded |= {tab} if on else set()
        last[tab] = (idle_phase, tab_phase, share)
    return out


def both(spark, events, settings):
    timeline = S.trigger_timeline(spark.createDataFrame(events, EVENTS),
                                  spark.createDataFrame([(k, *v) for k, v in settings.items()], SETTINGS), 60)
    rows = timeline.collect()
    got = sorted((r.event_id, r.tab_id, r.seq, r.idle_phase, r.tab_phase, r.idle_on, r.tab_on, r.share_on,
                  r.share_suspended, r.master_on) for r in rows)
    shown = sorted((r.event_id, r.tab_id, r.notice) for r in S.trigger_notices(timeline).collect())
    return got, shown


@pytest.mark.parametrize("seed", [1, 2])
def test_random_events(spark, seed):
    rng = random.Random(seed)
    kinds = ["focus", "hide", "lock", "share_open", "share_open", "share_close", "ignore_tab", "unignore_tab", "ignore_site",
             "unignore_site", "suspend", "resume", "enable", "enable", "disable", "other"]
    events, at = [], START
    for k in range(400):
        at += timedelta(seconds=rng.choice([0, 0, 1, 20, 59, 60, 61, 400, 5000]))
        tab, kind = rng.choice([1, 1, 1, 2, 3, 4, 9]), rng.choice(kinds)
        events.append((1000 - k if seed == 2 else k, at, tab, f"h{tab % 2}", kind,
                       rng.choice("ab") if kind.startswith("share") else None,
                       rng.choice(TRIGGERS) if "ignore" in kind or kind in ("suspend", "resume") else None))
    settings = {1: (True, True, True, True), 2: (True, True, True, False), 3: (None, True, True, None), 4: (True, None, True, True)}
    want = simulate(events, settings)
    got, shown = both(spark, events, settings)
    assert got == sorted(want)
    assert shown == sorted(notices(want))
    assert len({n for _, _, n in shown}) > 3


def event(k, minute, tab, kind, stream=None, trigger=None):
    return k, START + timedelta(minutes=minute), tab, "h", kind, stream, trigger


def test_master_switch_and_suspension(spark):
    on = (True, True, True, True)
    events = [event(1, 0, 1, "focus"), event(2, 0.1, 2, "share_open", "s"), event(3, 0.2, 1, "focus"),
              event(4, 0.3, 1, "suspend", None, "screen_share"), event(5, 0.4, 1, "resume", None, "screen_share"),
              event(6, 0.5, 1, "disable"), event(7, 0.6, 1, "enable"), event(8, 0.7, 2, "share_close", "s"), event(9, 0.8, 1, "lock")]
    _, shown = both(spark, events, {1: on})
    assert shown == [(3, 1, "share_show"), (4, 1, "share_dismiss"), (4, 1, "share_suspended"), (5, 1, "share_show"),
                     (6, 1, "share_dismiss"), (7, 1, "share_show"), (9, 1, "idle_show"), (9, 1, "share_dismiss"), (9, 1, "tab_show")]


def test_nothing_and_strange_rows(spark):
    assert both(spark, [], {1: (True,) * 4}) == ([], [])
    odd = [(1, START, None, None, None, None, None), (2, START, 5, None, "ignore_site", None, None), (3, START, 1, None, "focus", None, None)]
    got, shown = both(spark, odd, {1: (True,) * 4})
    assert [r[:5] for r in got] == [(3, 1, 0, "active", "off"), (3, 1, 1, "idle", "off")] and shown == [(3, 1, "idle_show")]
