"""Queries over control events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..sources import control, profiles, tables
from ..operators import policy
from .registry import query

c = F.col
THRESHOLD = 3600


def _events(spark, sf_dir):
    return control.control_events(spark, sf_dir)


def _live(events):
    """Tabs seen in the last hours of the stream."""
    end = events.agg(F.max("ts")).scalar()
    seen = events.groupBy("tab_id").agg(F.max("ts").alias("seen")).withColumn("end", end)
    return seen.where(c("seen") > c("end") - F.expr("INTERVAL 6 HOURS")).select("tab_id")


@query("idle_phase")
def idle_phase(spark, sf_dir):
    """Phase transitions per tab."""
    return S.idle_phases(_events(spark, sf_dir), THRESHOLD).select("tab_id", "event_id", "phase", c("at").cast("string").alias("happened_at"))


@query("idle_threshold")
def idle_threshold(spark, sf_dir):
    """Threshold in seconds of every profile, within the platform limits."""
    loaded = policy.load(profiles.profiles(spark, sf_dir))
    seconds = F.when(c("idle_unit") == "min", c("idle_value") * 60).otherwise(c("idle_value"))
    return loaded.select("profile", F.greatest(F.lit(15.0), F.least(F.lit(3600.0), seconds)).alias("seconds"))


@query("phase_changes")
def phase_changes(spark, sf_dir):
    """Idle transitions that change the phase."""
    phases = S.idle_phases(_events(spark, sf_dir), THRESHOLD)
    return S.changes(phases, ["tab_id"], ["at", "event_id"], S.slot("at")).select(
        "tab_id", "event_id", "phase", c("at").cast("string").alias("happened_at"))


@query("tab_phase")
def tab_phase(spark, sf_dir):
    return S.tab_phases(_events(spark, sf_dir))


@query("share_sessions")
def share_sessions(spark, sf_dir):
    return S.share_sessions(_events(spark, sf_dir)).select(
        "tab_id", c("started_at").cast("string"), c("ended_at").cast("string"), "max_streams", "opens")


@query("share_state")
def share_state(spark, sf_dir):
    return S.open_shares(_events(spark, sf_dir)).select("tab_id", "streams", c("started_at").cast("string"))


@query("share_legacy_shape")
def share_legacy_shape(spark, sf_dir):
    return S.share_records(control.share_records(spark, sf_dir)).select(
        "owner", "tab", "stream", "started_at", F.array_join("sites", ",").alias("sites"))


@query("share_clear_ignores")
def share_clear_ignores(spark, sf_dir):
    return S.cleared_ignores(_events(spark, sf_dir)).select("event_id", "tab_id", c("cleared_at").cast("string"))


@query("stale_share_cleanup")
def stale_share_cleanup(spark, sf_dir):
    events = _events(spark, sf_dir)
    return S.drop_stale(S.open_shares(events), _live(events)).select("tab_id", "streams")


@query("ignore_lists")
def ignore_lists(spark, sf_dir):
    return S.ignore_lists(_events(spark, sf_dir))


@query("suspend_flags")
def suspend_flags(spark, sf_dir):
    return S.suspend_flags(_events(spark, sf_dir))


@query("effective_trigger")
def effective_trigger(spark, sf_dir):
    """Triggers that act on each tab, under the settings of the profile with its number."""
    events = _events(spark, sf_dir)
    settings = policy.load(profiles.profiles(spark, sf_dir)).select(
        c("profile").alias("tab_id"), "idle_enabled", "tab_switch_enabled", "share_enabled")
    tabs = events.select("tab_id", "host").distinct().join(settings, "tab_id")
    idle = S.idle_phases(events, THRESHOLD).groupBy("tab_id").agg(
        F.max_by("phase", F.struct("at", "event_id")).alias("phase"))
    return S.effective_triggers(tabs, idle, S.tab_phases(events), S.open_shares(events),
                                S.ignore_lists(events), S.suspend_flags(events))


def evaluations(spark, sf_dir):
    """One evaluation per event, with flags read off the event."""
    return tables.read(spark, sf_dir, "events").select(
        "event_id", c("ts").cast("timestamp").alias("ts"), (c("user_id") % 40).alias("tab_id"),
        F.when(c("event_type") == "error", "idle").when(c("event_type") == "signup", "locked")
        .otherwise("active").alias("idle_phase"),
        (c("event_type").isin("error", "signup") & (c("event_id") % 7 != 0)).alias("idle_on"),
        F.when(c("event_type") == "view", "fired").otherwise("off").alias("tab_phase"),
        ((c("event_type") == "view") & (c("event_id") % 5 != 0)).alias("tab_on"),
        (c("event_id") % 3 == 0).alias("share_on"))


@query("trigger_edges")
def trigger_edges(spark, sf_dir):
    return S.trigger_edges(evaluations(spark, sf_dir))


def tab_settings(spark, sf_dir):
    """Settings of the profile with a tab's number, folded with the site rules for the tab's host."""
    loaded = policy.load(profiles.profiles(spark, sf_dir)).withColumnRenamed("profile", "tab_id")
    tabs = _events(spark, sf_dir).select("tab_id", F.concat(F.lit("https://"), c("host"), F.lit("/")).alias("url")).distinct()
    base = {n: c(f"base_{n}") for n in policy.DEFAULTS}
    pages = tabs.join(loaded.select("tab_id", *[c(n).alias(f"base_{n}") for n in policy.DEFAULTS]), "tab_id")
    book = policy.RuleBook.of(policy.normalise_rules(profiles.site_rules(spark, sf_dir)))
    return policy.fold(pages, book, base).select(
        "tab_id", "idle_enabled", "tab_switch_enabled", "share_enabled", "enabled")


@query("trigger_timeline")
def trigger_timeline(spark, sf_dir):
    """What acts on a tab at each of its evaluations."""
    timeline = S.trigger_timeline(_events(spark, sf_dir), tab_settings(spark, sf_dir), THRESHOLD)
    return timeline.withColumn("happened_at", c("at").cast("string")).drop("at", "seq")


@query("trigger_notices")
def trigger_notices(spark, sf_dir):
    """Notices on the edges of these evaluations."""
    timeline = S.trigger_timeline(_events(spark, sf_dir), tab_settings(spark, sf_dir), THRESHOLD)
    return S.trigger_notices(timeline).select("event_id", "tab_id", c("at").cast("string").alias("happened_at"), "notice")


@query("notify_targets")
def notify_targets(spark, sf_dir):
    events = _events(spark, sf_dir)
    return S.notify_counts(events, events.select("tab_id").distinct())


@query("url_change_debounce")
def url_change_debounce(spark, sf_dir):
    """Bursts of one tab settle after an hour of quiet here: the stream is sparse."""
    events = tables.read(spark, sf_dir, "events").select(
        "event_id", c("ts").cast("timestamp").alias("ts"), c("user_id").alias("tab_id"), c("event_type").alias("url"))
    return S.debounce(events, ["tab_id"], 3_600_000).select("event_id", "tab_id", "url")


@query("latest_text")
def latest_text(spark, sf_dir):
    """Newest text per speaker of a conversation, a speaker standing for a node."""
    turns = tables.read(spark, sf_dir, "conversations")
    newest = S.latest_text(turns, ["conv_id", "role"], "text", ["turn"])
    return newest.select("conv_id", "role", F.md5("text").alias("text_md5"))
