"""Idle, tab and screen-share state folded from control events.

Input ``events(event_id, ts, tab_id, host, kind, stream_id, trigger)``. Order
is by ``(ts, event_id)``. Ordered steps run per tab and minute, and over all
tabs per second, so that neither a busy tab nor the whole stream meets in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import windows as W
from ..sources.tables import materialise

ORDER = ["ts", "event_id"]


def slot(ts: str = "ts") -> Column:
    """The piece of time that is put in order as one."""
    return F.date_trunc("minute", ts)


#: An order over all tabs: put in order by the second, carried by the hour and the month.
ACROSS = (lambda b: F.date_trunc("hour", b), lambda b: F.date_trunc("month", b))


def instant(ts: str = "ts") -> Column:
    """The piece of time of all tabs that is put in order as one."""
    return F.date_trunc("second", ts)


def last_of(value, when: Column | None = None) -> Column:
    at = F.struct(*ORDER)
    return F.max_by(value, at if when is None else F.when(when, at))


def clamp_threshold(seconds: float | None) -> float:
    """Idle threshold in seconds, within the limits of the platform."""
    value = V.IDLE_DEFAULT_SECONDS if seconds is None else seconds
    return max(V.IDLE_MIN_SECONDS, min(V.IDLE_MAX_SECONDS, value))


def idle_phases(events: DataFrame, threshold: float | None = None) -> DataFrame:
    """Phase transitions per tab: activity, silence beyond the threshold, explicit locks."""
    limit = clamp_threshold(threshold)
    nexted = W.previous(events, ["tab_id"], slot(), ORDER, F.col("ts"), "next_ts", backward=True)
    here = F.struct(F.col("ts").alias("at"), F.when(F.col("kind") == "lock", "locked")
                    .otherwise("active").alias("phase"))
    silent = F.col("next_ts").isNull() | (
        F.col("next_ts") > F.col("ts") + F.make_dt_interval(secs=F.lit(limit)))
    idle = F.when(silent & (F.col("kind") != "lock"), F.struct(
        (F.col("ts") + F.make_dt_interval(secs=F.lit(limit))).alias("at"), F.lit("idle").alias("phase")))
    return nexted.select("tab_id", "event_id", F.inline(F.array_compact(F.array(here, idle))))


def changes(phases: DataFrame, keys: list[str], order: list[str], bucket: Column,
            phase: str = "phase") -> DataFrame:
    """Only the rows whose phase differs from the one before."""
    before = W.previous(phases, keys, bucket, order, F.col(phase), "_prev")
    return before.where(~F.col(phase).eqNullSafe(F.col("_prev"))).drop("_prev")


def tab_phases(events: DataFrame) -> DataFrame:
    """Latest phase of every tab: fired while hidden or unfocused."""
    seen = events.where(F.col("kind").isin("focus", "hide", "lock"))
    return seen.groupBy("tab_id").agg(last_of(F.col("kind")).alias("last")).select(
        "tab_id", F.when(F.col("last") == "focus", "off").otherwise("fired").alias("phase"))


def share_steps(events: DataFrame) -> DataFrame:
    """Opens and closes that change the set of open streams of a tab, as +1 and -1."""
    shares = events.where(F.col("kind").isin("share_open", "share_close"))
    before = W.previous(shares, ["tab_id", "stream_id"], slot(), ORDER, F.col("kind"), "_before")
    opened, was_open = F.col("kind") == "share_open", F.coalesce(F.col("_before") == "share_open", F.lit(False))
    return before.withColumn("step", F.when(opened & ~was_open, 1).when(~opened & was_open, -1).otherwise(0)) \
        .drop("_before")


def share_sessions(events: DataFrame) -> DataFrame:
    """Sharing sessions per tab: from the first open stream to the close of the last one."""
    steps = share_steps(events).where(F.col("step") != 0)
    open_now = W.running_sum(steps, ["tab_id"], slot(), ORDER, F.col("step"), "n_open")
    starts = (F.col("step") == 1) & (F.col("n_open") == 1)
    marked = W.latest(open_now, ["tab_id"], slot(), ORDER, F.when(starts, F.struct("ts", "event_id")), "began")
    return marked.groupBy("tab_id", "began").agg(
        F.max(F.when(F.col("n_open") == 0, F.col("ts"))).alias("ended_at"),
        F.max("n_open").alias("max_streams"),
        F.count_if(F.col("step") == 1).alias("opens"),
    ).select("tab_id", F.col("began.ts").alias("started_at"), "ended_at", "max_streams", "opens")


def open_shares(events: DataFrame) -> DataFrame:
    """Tabs sharing right now, with the start of their oldest open stream."""
    shares = events.where(F.col("kind").isin("share_open", "share_close"))
    state = shares.groupBy("tab_id", "stream_id").agg(
        last_of(F.col("kind")).alias("last"), last_of(F.col("ts")).alias("at"))
    return state.where(F.col("last") == "share_open").groupBy("tab_id").agg(
        F.count("*").alias("streams"), F.min("at").alias("started_at"))


def cleared_ignores(events: DataFrame) -> DataFrame:
    """Share ignores of tabs, each with the next share start, which resets the list."""
    relevant = events.where(
        (F.col("kind") == "share_open")
        | ((F.col("kind") == "ignore_tab") & (F.col("trigger") == "screen_share")))
    nexted = W.latest(relevant, [], instant(), ORDER, F.when(F.col("kind") == "share_open", F.col("ts")),
                      "cleared_at", following=True, coarser=ACROSS)
    return nexted.where(F.col("kind") == "ignore_tab").select("event_id", "tab_id", "ts", "cleared_at")


def ignore_lists(events: DataFrame) -> DataFrame:
    """Tabs and sites ignored per trigger: the last operation on each wins.

    A new share empties the share list of tabs, so only later entries count there.
    """
    ops = events.where(F.col("kind").isin("ignore_tab", "unignore_tab", "ignore_site", "unignore_site"))
    scope = F.when(F.col("kind").endswith("tab"), "tab").otherwise("site")
    entry = F.when(scope == "tab", F.col("tab_id").cast("string")).otherwise(F.col("host"))
    last = ops.groupBy("trigger", scope.alias("scope"), entry.alias("entry")).agg(
        last_of(F.col("kind")).alias("op"), F.max(F.struct(*ORDER)).alias("at"))
    reset = events.where(F.col("kind") == "share_open").agg(F.max(F.struct(*ORDER))).scalar()
    kept = last.where(F.col("op").startswith("ignore")).withColumn("reset", reset)
    resets = (F.col("trigger") == "screen_share") & (F.col("scope") == "tab")
    return kept.where(~resets | F.col("reset").isNull() | (F.col("at") > F.col("reset"))).select(
        "trigger", "scope", "entry")


def suspend_flags(events: DataFrame) -> DataFrame:
    """Suspended triggers; the end of the last share resumes the share trigger."""
    flags = events.where(F.col("kind").isin("suspend", "resume")).groupBy("trigger").agg(
        last_of(F.col("kind")).alias("op"), F.max(F.struct(*ORDER)).alias("at"))
    steps = share_steps(events).where(F.col("step") != 0)
    open_now = W.running_sum(steps, [], instant(), ORDER, F.col("step"), "n_open", coarser=ACROSS)
    quiet = open_now.where(F.col("n_open") == 0).agg(F.max(F.struct(*ORDER))).scalar()
    return flags.withColumn("quiet", quiet).select("trigger", F.when(
        F.col("op") == "resume", False).otherwise(
        ~((F.col("trigger") == "screen_share") & F.coalesce(F.col("quiet") > F.col("at"), F.lit(False)))
    ).alias("suspended"))


def drop_stale(shares: DataFrame, live_tabs: DataFrame) -> DataFrame:
    return shares.join(live_tabs.select("tab_id"), "tab_id", "left_semi")


_ENTRY = ("struct<streams:map<string,struct<started_at:bigint>>,started_at:bigint,"
          "suppressed_sites:array<string>>")
_OLD = "struct<active:boolean,sharing_tab_id:bigint,started_at:bigint,suppressed_sites:array<string>>"


def share_records(df: DataFrame, column: str = "record") -> DataFrame:
    """Stored share records of all three shapes as ``(.., tab, stream, started_at, sites)``."""
    old = F.from_json(column, _OLD)
    is_old = F.array_contains(F.json_object_keys(column), "active")
    entries = F.from_json(column, f"map<string,{_ENTRY}>")
    stream = "struct<tab:string,stream:string,started_at:bigint,sites:array<string>>"

    def sites(x: Column) -> Column:
        return F.coalesce(F.filter(x, lambda s: F.coalesce(s != "", F.lit(False))),
                          F.array().cast("array<string>"))

    def row(tab, name, at, where) -> Column:
        return F.struct(tab.cast("string").alias("tab"), name.alias("stream"), at.alias("started_at"),
                        where.alias("sites")).cast(stream)

    def of_entry(e: Column) -> Column:
        v = e["value"]
        listed = F.transform(F.filter(F.map_entries(v["streams"]), lambda s: s["value"]["started_at"].isNotNull()),
                             lambda s: row(e["key"], s["key"], s["value"]["started_at"], sites(v["suppressed_sites"])))
        flat = F.when(v["started_at"].isNotNull(), F.array(
            row(e["key"], F.lit("_migrated"), v["started_at"], sites(v["suppressed_sites"]))))
        return F.coalesce(F.when(v["streams"].isNotNull(), listed).otherwise(flat),
                          F.array().cast(f"array<{stream}>"))

    newer = F.flatten(F.transform(
        F.filter(F.map_entries(entries), lambda e: e["key"].rlike(r"\A[0-9]+\z") & e["value"].isNotNull()), of_entry))
    older = F.when(old["active"] & old["sharing_tab_id"].isNotNull(), F.array(
        row(old["sharing_tab_id"], F.lit("_migrated"), old["started_at"], sites(old["suppressed_sites"]))))
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.inline(F.when(is_old, older).otherwise(newer)))


def effective_triggers(tabs: DataFrame, idle: DataFrame, phases: DataFrame, shares: DataFrame,
                       ignores: DataFrame, suspended: DataFrame) -> DataFrame:
    """Which triggers act on each tab.

    ``tabs(tab_id, host, idle_enabled, tab_switch_enabled, share_enabled)``. The
    ignore list of tabs reset by new shares holds for the share trigger only;
    a sharing tab is never covered by its own share.
    """
    def ignored(trigger: str, scope: str, name: str) -> DataFrame:
        return ignores.where((F.col("trigger") == trigger) & (F.col("scope") == scope)).select(
            F.col("entry").alias(f"{name}_key"), F.lit(True).alias(name))

    out = tabs.join(idle.select("tab_id", F.col("phase").alias("idle_phase")), "tab_id", "left") \
        .join(phases.select("tab_id", F.col("phase").alias("tab_phase")), "tab_id", "left") \
        .join(shares.select("tab_id", F.lit(True).alias("sharing")), "tab_id", "left")
    for trigger, scope in (("idle", "tab"), ("idle", "site"), ("tab_switch", "tab"),
                           ("tab_switch", "site"), ("screen_share", "tab"), ("screen_share", "site")):
        name = f"{trigger}_{scope}"
        key = F.col("tab_id").cast("string") if scope == "tab" else F.col("host")
        part = ignored(trigger, scope, name)
        out = out.join(part, key == part[f"{name}_key"], "left").drop(f"{name}_key")
    flags = suspended.agg(F.struct(*[
        F.coalesce(F.max(F.when(F.col("trigger") == t, F.col("suspended"))), F.lit(False)).alias(f"{t}_off")
        for t in ("idle", "tab_switch", "screen_share")])).scalar()
    active = shares.agg(F.count("*") > 0).scalar()
    out = out.withColumn("flags", flags).withColumn("share_active", active).select("*", "flags.*")

    def no(name: str) -> Column:
        return ~F.coalesce(F.col(name), F.lit(False))
    idle_on = F.col("idle_enabled") & ~F.col("idle_off") & F.coalesce(
        F.col("idle_phase").isin("idle", "locked"), F.lit(False)) & no("idle_tab") & no("idle_site")
    switch_on = F.col("tab_switch_enabled") & ~F.col("tab_switch_off") & F.coalesce(
        F.col("tab_phase") == "fired", F.lit(False)) & no("tab_switch_tab") & no("tab_switch_site")
    share_on = F.col("share_active") & F.col("share_enabled") & ~F.col("screen_share_off") \
        & no("screen_share_site") & no("sharing") & no("screen_share_tab")
    return out.select("tab_id", "host", idle_on.alias("idle"), switch_on.alias("tab_switch"),
                      share_on.alias("screen_share")).withColumn(
        "active", F.col("idle") | F.col("tab_switch") | F.col("screen_share"))


def trigger_edges(evaluations: DataFrame) -> DataFrame:
    """Notices on rising and falling edges; the first evaluation of a tab only seeds.

    ``evaluations(event_id, ts, tab_id, idle_phase, idle_on, tab_phase, tab_on, share_on)``.
    A share outranks idle for the one notice slot.
    """
    now = F.struct("idle_phase", "tab_phase", "share_on")
    e = W.previous(evaluations, ["tab_id"], slot(), ORDER, now, "was")
    c, was = F.col, F.col("was")
    away = c("idle_phase").isin("idle", "locked")
    notices = F.array(
        F.when(c("idle_on") & (c("idle_phase") != was["idle_phase"]) & away & ~c("share_on"), "idle_show")
        .when(~c("idle_on") & (was["idle_phase"] != "active") & (c("idle_phase") == "active")
              & ~c("share_on"), "idle_dismiss"),
        F.when(c("tab_on") & (c("tab_phase") != was["tab_phase"]) & (c("tab_phase") == "fired"), "tab_show"),
        F.when(c("share_on") & ~was["share_on"], "share_show")
        .when(~c("share_on") & was["share_on"], "share_dismiss"))
    return e.where(was.isNotNull()).select("event_id", "tab_id", F.explode(F.array_compact(notices)).alias("notice"))


#: Order of evaluations: an event, then the silence after it.
EVALUATED = ["at", "event_id", "seq"]


def trigger_timeline(events: DataFrame, settings: DataFrame, threshold: float | None = None) -> DataFrame:
    """Evaluations of every tab: at each of its own events and where silence makes it idle.

    ``settings(tab_id, idle_enabled, tab_switch_enabled, share_enabled, enabled)``
    holds the folded settings of a tab, a null being off for a trigger and on for
    ``enabled``; tabs without settings have no evaluations. Each evaluation sees the state as of its moment: phases, shares
    and ignore lists of the tab, the ignored sites, and what holds for all tabs
    (suspended triggers, open shares, the master switch, which events of kind
    ``enable`` and ``disable`` move). Changes made elsewhere count from the next
    evaluation of a tab, so events and tabs are never paired. Equal times are
    ordered by event_id. Every state is carried over bucket borders by one row
    per bucket, all states of a scope in one pass; results between passes are
    stored, so ``events`` is read for the steps of shares and once more.
    """
    c = F.col
    steps = materialise(share_steps(events), "share-steps")
    own = materialise(W.running_sum(steps, ["tab_id"], slot(), ORDER, c("step"), "own_sum"), "share-own")
    shares = W.running_sum(own, [], instant(), ORDER, c("step"), "all_sum", coarser=ACROSS)
    is_share = F.coalesce(c("kind").isin("share_open", "share_close"), F.lit(False))
    rows = materialise(shares.unionByName(events.where(~is_share), allowMissingColumns=True), "share-rows")

    limit = F.make_dt_interval(secs=F.lit(clamp_threshold(threshold)))
    nexted = W.previous(rows, ["tab_id"], slot(), ORDER, c("ts"), "next_ts", backward=True)
    fields = ("kind", "trigger", "step", "own_sum", "all_sum")
    types = dict(rows.dtypes)
    locked = F.coalesce(c("kind") == "lock", F.lit(False))
    here = F.struct(c("ts").alias("at"), F.lit(0).alias("seq"), F.when(locked, "locked").otherwise("active").alias(
        "idle_phase"), *[c(f) for f in fields])
    silent = (c("next_ts").isNull() | (c("next_ts") > c("ts") + limit)) & ~locked
    later = F.when(silent, F.struct((c("ts") + limit).alias("at"), F.lit(1).alias("seq"), F.lit("idle").alias(
        "idle_phase"), *[F.lit(None).cast(types[f]).alias(f) for f in fields]))
    points = materialise(nexted.select("event_id", "tab_id", "host", F.inline(F.array_compact(F.array(here, later)))), "points")

    now = [c("at").alias("at"), c("event_id").alias("event_id")]

    def op(trigger: str, on: str, off: str, timed: bool = False) -> Column:
        said = (c("kind") == on).alias("on")
        return F.when(c("kind").isin(on, off) & (c("trigger") == trigger), F.struct(said, *now) if timed else said)
    of_tab = W.latest_each(points, ["tab_id"], slot("at"), EVALUATED, {
        "tab_phase": F.when(c("kind").isin("focus", "hide", "lock"), F.when(c("kind") == "focus", "off").otherwise("fired")),
        "own_open": c("own_sum"), "idle_tab": op("idle", "ignore_tab", "unignore_tab"),
        "switch_tab": op("tab_switch", "ignore_tab", "unignore_tab"),
        "share_tab": op("screen_share", "ignore_tab", "unignore_tab", timed=True)})
    of_site = W.latest_each(materialise(of_tab.drop("own_sum"), "of-tab"), ["host"], slot("at"), EVALUATED, {
        f"{n}_site": op(t, "ignore_site", "unignore_site")
        for n, t in (("idle", "idle"), ("switch", "tab_switch"), ("share", "screen_share"))})
    of_all = W.latest_each(materialise(of_site.drop("host"), "of-site"), [], instant("at"), EVALUATED, {
        "all_open": c("all_sum"), "reset": F.when(c("kind") == "share_open", F.struct(*now)),
        "quiet": F.when((c("step") != 0) & (c("all_sum") == 0), F.struct(*now)),
        "idle_off": op("idle", "suspend", "resume"), "switch_off": op("tab_switch", "suspend", "resume"),
        "share_off": op("screen_share", "suspend", "resume", timed=True),
        "switched": F.when(c("kind").isin("enable", "disable"), c("kind") == "enable")}, coarser=ACROSS)

    def yes(x: Column) -> Column:
        return F.coalesce(x, F.lit(False))

    def after(op_column: str, reset: str) -> Column:
        """Said, and not undone since."""
        said = F.struct(c(op_column)["at"].alias("at"), c(op_column)["event_id"].alias("event_id"))
        return yes(c(op_column)["on"] & (c(reset).isNull() | (said > c(reset))))
    found = of_all.join(settings.select("tab_id", "idle_enabled", "tab_switch_enabled", "share_enabled", "enabled"), "tab_id")
    master = F.coalesce(c("switched"), c("enabled"), F.lit(True))
    sharing, suspended = F.coalesce(c("all_open"), F.lit(0)) > 0, after("share_off", "quiet")
    idle_on = yes(c("idle_enabled")) & ~yes(c("idle_off")) & c("idle_phase").isin("idle", "locked") \
        & ~yes(c("idle_tab")) & ~yes(c("idle_site"))
    tab_on = yes(c("tab_switch_enabled")) & ~yes(c("switch_off")) & yes(c("tab_phase") == "fired") \
        & ~yes(c("switch_tab")) & ~yes(c("switch_site"))
    share_on = sharing & yes(c("share_enabled")) & ~suspended & ~yes(c("share_site")) \
        & (F.coalesce(c("own_open"), F.lit(0)) == 0) & ~after("share_tab", "reset")
    return found.select(
        "event_id", "tab_id", "at", "seq", "idle_phase", F.coalesce("tab_phase", F.lit("off")).alias("tab_phase"),
        (master & idle_on).alias("idle_on"), (master & tab_on).alias("tab_on"), (master & share_on).alias("share_on"),
        (sharing & suspended).alias("share_suspended"), master.alias("master_on"))


def trigger_notices(timeline: DataFrame) -> DataFrame:
    """Notices on the edges of a timeline.

    The first evaluation with the master switch on only seeds. While it is off
    nothing is shown, and a share notice that still stands is dismissed. A share
    outranks idle for the one notice slot; one that ends by suspension while
    streams are open says so.
    """
    c, was = F.col, F.col("was")
    stored = materialise(timeline, "timeline")
    seen = W.running_sum(stored, ["tab_id"], slot("at"), EVALUATED, c("master_on").cast("int"), "seen")
    e = W.previous(materialise(seen, "seen"), ["tab_id"], slot("at"), EVALUATED,
                   F.struct("idle_phase", "tab_phase", "share_on"), "was")
    away = c("idle_phase").isin("idle", "locked")
    ended = ~c("share_on") & was["share_on"]
    shown = F.array(
        F.when(c("idle_on") & (c("idle_phase") != was["idle_phase"]) & away & ~c("share_on"), "idle_show")
        .when(~c("idle_on") & (was["idle_phase"] != "active") & ~away & ~c("share_on"), "idle_dismiss"),
        F.when(c("tab_on") & (c("tab_phase") != was["tab_phase"]) & (c("tab_phase") == "fired"), "tab_show"),
        F.when(c("share_on") & ~was["share_on"], "share_show").when(ended, "share_dismiss"),
        F.when(ended & c("share_suspended"), "share_suspended"))
    notices = F.when(~c("master_on"), F.array(F.when(ended, "share_dismiss"))).when(c("seen") > 1, shown)
    return e.select("event_id", "tab_id", "at", F.explode(F.array_compact(notices)).alias("notice"))


def notify_counts(events: DataFrame, tabs: DataFrame) -> DataFrame:
    """Notices each tab receives: one per share start of any other tab, one per share end.

    Counted, not enumerated: the pairs of events and tabs never exist.
    """
    starts, ends = F.col("kind") == "share_open", F.col("kind") == "share_close"
    all_of = events.agg(F.count_if(starts) + F.count_if(ends)).scalar()
    own = events.where(starts).groupBy("tab_id").agg(F.count("*").alias("own"))
    return tabs.join(own, "tab_id", "left").withColumn("all", all_of).select(
        "tab_id", (F.col("all") - F.coalesce(F.col("own"), F.lit(0))).alias("notices"))


def debounce(events: DataFrame, keys: list[str], quiet_ms: int = V.URL_CHANGE_QUIET_MS,
             url: str = "url") -> DataFrame:
    """Last event of every burst whose url differs from the one reported before."""
    nexted = W.previous(events, keys, slot(), ORDER, F.col("ts"), "next_ts", backward=True)
    settled = nexted.where(F.col("next_ts").isNull() | (
        F.col("next_ts") >= F.col("ts") + F.make_dt_interval(secs=F.lit(quiet_ms / 1000)))).drop("next_ts")
    return changes(settled, keys, ORDER, slot(), url)


def latest_text(changes_df: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """Newest text of every node; only the newest survives the map-side aggregation."""
    return changes_df.groupBy(*keys).agg(F.max_by(text, F.struct(*order)).alias(text))
