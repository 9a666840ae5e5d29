"""SQL for control events."""

from __future__ import annotations

from maskwright.sources import control

from . import queries_pages
from . import queries_policy as QP

SQL: dict[str, str] = {}
E = f"({control.SELECT_SQL})"


def stamp(x: str) -> str:
    """Timestamp text without trailing zeros, as Spark prints it."""
    return f"regexp_replace(regexp_replace(strftime({x}, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '[.]$', '')"


IDLE = f"""(WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS next_ts FROM {E})
  SELECT tab_id, event_id, ts AS happened_at, CASE WHEN kind = 'lock' THEN 'locked' ELSE 'active' END AS phase FROM n
  UNION ALL SELECT tab_id, event_id, ts + INTERVAL 3600 SECOND, 'idle' FROM n
  WHERE kind <> 'lock' AND (next_ts IS NULL OR next_ts > ts + INTERVAL 3600 SECOND))"""
SQL["idle_phase"] = f"SELECT tab_id, event_id, phase, {stamp('happened_at')} AS happened_at FROM {IDLE}"
SQL["idle_threshold"] = (
    "SELECT profile, greatest(15, least(3600, CASE WHEN idle_unit = 'min' THEN idle_value * 60 ELSE idle_value END)) AS seconds "
    f"FROM ({QP.LOADED})")
SQL["phase_changes"] = f"""
SELECT tab_id, event_id, phase, {stamp('happened_at')} AS happened_at FROM (
  SELECT *, lag(phase) OVER (PARTITION BY tab_id ORDER BY happened_at, event_id) AS was FROM {IDLE}) WHERE phase IS DISTINCT FROM was"""
TAB = (f"(SELECT tab_id, CASE WHEN arg_max(kind, (ts, event_id)) = 'focus' THEN 'off' ELSE 'fired' END AS phase FROM {E} "
       f"WHERE kind IN ('focus', 'hide', 'lock') GROUP BY tab_id)")
SQL["tab_phase"] = f"SELECT * FROM {TAB}"
STEPS = f"""(SELECT * FROM (SELECT *, CASE WHEN kind = 'share_open' AND was IS DISTINCT FROM 'share_open' THEN 1
    WHEN kind = 'share_close' AND was = 'share_open' THEN -1 ELSE 0 END AS step FROM (
    SELECT *, lag(kind) OVER (PARTITION BY tab_id, stream_id ORDER BY ts, event_id) AS was FROM {E}
    WHERE kind IN ('share_open', 'share_close'))) WHERE step <> 0)"""
SQL["share_sessions"] = f"""
WITH r AS (SELECT *, sum(step) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS n_open FROM {STEPS}),
g AS (SELECT *, sum(CASE WHEN step = 1 AND n_open = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS no FROM r)
SELECT tab_id, {stamp('min(ts)')} AS started_at, {stamp('max(ts) FILTER (n_open = 0)')} AS ended_at,
  CAST(max(n_open) AS BIGINT) AS max_streams, count_if(step = 1) AS opens FROM g GROUP BY tab_id, no"""
OPEN = f"""(SELECT tab_id, count(*) AS streams, min(happened_at) AS started_at FROM (SELECT tab_id, stream_id, max(ts) AS happened_at,
  arg_max(kind, (ts, event_id)) AS last FROM {E} WHERE kind IN ('share_open', 'share_close') GROUP BY 1, 2)
  WHERE last = 'share_open' GROUP BY tab_id)"""
SQL["share_state"] = f"SELECT tab_id, streams, {stamp('started_at')} AS started_at FROM {OPEN}"
_j = "CAST(record AS JSON)"
SQL["share_legacy_shape"] = f"""
WITH r AS (SELECT c_custkey AS owner, CAST(record AS JSON) AS j FROM (SELECT *, {control.RECORD_SQL} AS record FROM customer)),
e AS (SELECT owner, k AS tab, json_extract(j, '$."' || k || '"') AS v FROM (SELECT owner, j, unnest(json_keys(j)) AS k FROM r
  WHERE json_type(j) = 'OBJECT' AND NOT list_contains(json_keys(j), 'active')) WHERE regexp_matches(k, '^[0-9]+$')),
s AS (SELECT owner, tab, v, unnest(json_keys(v, '$.streams')) AS stream FROM e WHERE json_type(v, '$.streams') = 'OBJECT')
SELECT owner, json_extract_string(j, '$.sharing_tab_id') AS tab, '_migrated' AS stream,
  CAST(json_extract_string(j, '$.started_at') AS BIGINT) AS started_at, 'a.com' AS sites FROM r
WHERE json_type(j) = 'OBJECT' AND json_extract_string(j, '$.active') = 'true' AND json_type(j, '$.sharing_tab_id') = 'UBIGINT'
UNION ALL SELECT owner, tab, '_migrated', CAST(json_extract_string(v, '$.started_at') AS BIGINT),
  coalesce(array_to_string(json_extract_string(v, '$.suppressed_sites[*]'), ','), '') FROM e
WHERE coalesce(json_type(v, '$.streams'), '') <> 'OBJECT' AND json_type(v, '$.started_at') = 'UBIGINT'
UNION ALL SELECT owner, tab, stream, CAST(json_extract_string(v, '$.streams."' || stream || '".started_at') AS BIGINT), '' FROM s
WHERE json_type(v, '$.streams."' || stream || '".started_at') = 'UBIGINT'"""
SQL["share_clear_ignores"] = f"""
SELECT i.event_id, i.tab_id, {stamp('(SELECT min(o.ts) FROM ' + E + " o WHERE o.kind = 'share_open' AND (o.ts, o.event_id) > (i.ts, i.event_id))")} AS cleared_at
FROM {E} i WHERE i.kind = 'ignore_tab' AND i.trigger = 'screen_share'"""
LIVE = f"(SELECT tab_id FROM {E} GROUP BY tab_id HAVING max(ts) > (SELECT max(ts) FROM {E}) - INTERVAL 6 HOUR)"
SQL["stale_share_cleanup"] = f"SELECT tab_id, streams FROM {OPEN} WHERE tab_id IN (SELECT tab_id FROM {LIVE})"
IGN = f"""(SELECT trigger, scope, entry FROM (SELECT trigger, scope, entry, arg_max(kind, (ts, event_id)) AS op, max((ts, event_id)) AS happened_at
  FROM (SELECT *, CASE WHEN ends_with(kind, 'tab') THEN 'tab' ELSE 'site' END AS scope,
    CASE WHEN ends_with(kind, 'tab') THEN CAST(tab_id AS VARCHAR) ELSE host END AS entry FROM {E} WHERE contains(kind, 'ignore'))
  GROUP BY 1, 2, 3) WHERE starts_with(op, 'ignore') AND (NOT (trigger = 'screen_share' AND scope = 'tab')
    OR happened_at > (SELECT max((ts, event_id)) FROM {E} WHERE kind = 'share_open')))"""
SQL["ignore_lists"] = f"SELECT * FROM {IGN}"
SUS = f"""(SELECT trigger, op = 'suspend' AND NOT (trigger = 'screen_share' AND coalesce((SELECT max((ts, event_id)) FROM (
  SELECT *, sum(step) OVER (ORDER BY ts, event_id) AS n_open FROM {STEPS}) WHERE n_open = 0) > happened_at, false)) AS suspended
  FROM (SELECT trigger, arg_max(kind, (ts, event_id)) AS op, max((ts, event_id)) AS happened_at FROM {E}
    WHERE kind IN ('suspend', 'resume') GROUP BY trigger))"""
SQL["suspend_flags"] = f"SELECT * FROM {SUS}"


def _listed(trigger: str, scope: str, key: str) -> str:
    return f"EXISTS (SELECT 1 FROM ign WHERE trigger = '{trigger}' AND scope = '{scope}' AND entry = {key})"


def _off(t: str) -> str:
    return f"coalesce((SELECT bool_or(suspended) FROM sus WHERE trigger = '{t}'), false)"


SQL["effective_trigger"] = f"""
WITH ign AS MATERIALIZED (SELECT * FROM {IGN}), sus AS MATERIALIZED (SELECT * FROM {SUS}), op AS MATERIALIZED (SELECT * FROM {OPEN}),
cfg AS MATERIALIZED (SELECT profile, idle_enabled, tab_switch_enabled, share_enabled FROM ({QP.LOADED})),
ip AS MATERIALIZED (SELECT tab_id, arg_max(phase, (happened_at, event_id)) AS phase FROM {IDLE} GROUP BY tab_id), tp AS MATERIALIZED (SELECT * FROM {TAB}),
t AS (SELECT DISTINCT tab_id, host FROM {E})
SELECT tab_id, host, idle, tab_switch, screen_share, idle OR tab_switch OR screen_share AS active FROM (
  SELECT t.tab_id, t.host,
    idle_enabled AND NOT {_off('idle')} AND coalesce(ip.phase IN ('idle', 'locked'), false)
      AND NOT {_listed('idle', 'tab', 'CAST(t.tab_id AS VARCHAR)')} AND NOT {_listed('idle', 'site', 't.host')} AS idle,
    tab_switch_enabled AND NOT {_off('tab_switch')} AND coalesce(tp.phase = 'fired', false)
      AND NOT {_listed('tab_switch', 'tab', 'CAST(t.tab_id AS VARCHAR)')} AND NOT {_listed('tab_switch', 'site', 't.host')} AS tab_switch,
    share_enabled AND (SELECT count(*) FROM op) > 0 AND NOT {_off('screen_share')} AND t.tab_id NOT IN (SELECT tab_id FROM op)
      AND NOT {_listed('screen_share', 'tab', 'CAST(t.tab_id AS VARCHAR)')} AND NOT {_listed('screen_share', 'site', 't.host')} AS screen_share
  FROM t JOIN cfg ON cfg.profile = t.tab_id LEFT JOIN ip ON ip.tab_id = t.tab_id LEFT JOIN tp ON tp.tab_id = t.tab_id)"""
_eval = """(SELECT event_id, ts, user_id % 40 AS tab_id, CASE event_type WHEN 'error' THEN 'idle' WHEN 'signup' THEN 'locked' ELSE 'active' END AS idle_phase,
  event_type IN ('error', 'signup') AND event_id % 7 <> 0 AS idle_on, CASE WHEN event_type = 'view' THEN 'fired' ELSE 'off' END AS tab_phase,
  event_type = 'view' AND event_id % 5 <> 0 AS tab_on, event_id % 3 = 0 AS share_on FROM events)"""
SQL["trigger_edges"] = f"""
WITH w AS (SELECT *, lag(idle_phase) OVER o AS was_idle, lag(tab_phase) OVER o AS was_tab, lag(share_on) OVER o AS was_share
  FROM {_eval} WINDOW o AS (PARTITION BY tab_id ORDER BY ts, event_id))
SELECT event_id, tab_id, unnest(list_filter([
  CASE WHEN idle_on AND idle_phase <> was_idle AND idle_phase <> 'active' AND NOT share_on THEN 'idle_show'
    WHEN NOT idle_on AND was_idle <> 'active' AND idle_phase = 'active' AND NOT share_on THEN 'idle_dismiss' END,
  CASE WHEN tab_on AND tab_phase <> was_tab AND tab_phase = 'fired' THEN 'tab_show' END,
  CASE WHEN share_on AND NOT was_share THEN 'share_show' WHEN NOT share_on AND was_share THEN 'share_dismiss' END],
  lambda x: x IS NOT NULL)) AS notice FROM w WHERE was_idle IS NOT NULL"""
_tabs = f"(SELECT DISTINCT tab_id AS page_id, 'https://' || host || '/' AS url FROM {E})"
_globals = f"(SELECT * FROM {_tabs} JOIN ({QP.LOADED}) ON profile = page_id)"
CFG = QP.folded({n: f"g.{n}" for n in QP.FIELDS}).replace(queries_pages.RICH, _tabs).replace("FROM pages g", f"FROM {_globals} g")


def _said(trigger: str, on: str, off: str) -> str:
    return f"CASE WHEN kind IN ('{on}', '{off}') AND trigger = '{trigger}' THEN {{}} END"


def _last(x: str, over: str, name: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER {over} AS {name}"


_at = "(happened, event_id)"
_ops = [_last(_said(t, f"ignore_{s}", f"unignore_{s}").format(f"kind = 'ignore_{s}'"), w, f"{n}_{s}")
        for n, t in (("idle", "idle"), ("switch", "tab_switch"), ("share", "screen_share")) for s, w in (("tab", "t"), ("site", "h"))]
_ops += [_last(_said(t, "suspend", "resume").format("kind = 'suspend'"), "g", f"{n}_off")
         for n, t in (("idle", "idle"), ("switch", "tab_switch"), ("share", "screen_share"))]
_ops += [_last(_said("screen_share", "ignore_tab", "unignore_tab").format(_at), "t", "share_tab_at"),
         _last(_said("screen_share", "suspend", "resume").format(_at), "g", "share_off_at"),
         _last(f"CASE WHEN kind = 'share_open' THEN {_at} END", "g", "reset_at"),
         _last(f"CASE WHEN step <> 0 AND all_open = 0 THEN {_at} END", "g", "quiet_at"),
         _last("CASE WHEN kind IN ('focus', 'hide', 'lock') THEN CASE WHEN kind = 'focus' THEN 'off' ELSE 'fired' END END", "t", "tp")]
_o = "ORDER BY happened, event_id, seq ROWS UNBOUNDED PRECEDING"
TIMELINE = f"""(WITH e AS (SELECT x.*, coalesce(s.step, 0) AS step FROM {E} x LEFT JOIN (SELECT event_id AS sid, step FROM {STEPS}) s ON sid = event_id),
n AS (SELECT *, lead(ts) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS next_ts FROM e),
p AS (SELECT event_id, tab_id, host, ts AS happened, 0 AS seq, CASE WHEN kind = 'lock' THEN 'locked' ELSE 'active' END AS idle_phase, kind, trigger, step FROM n
  UNION ALL SELECT event_id, tab_id, host, ts + INTERVAL 3600 SECOND, 1, 'idle', NULL, NULL, 0 FROM n
  WHERE kind <> 'lock' AND (next_ts IS NULL OR next_ts > ts + INTERVAL 3600 SECOND)),
o AS (SELECT *, sum(step) OVER (PARTITION BY tab_id {_o}) AS own_open, sum(step) OVER ({_o}) AS all_open FROM p),
v AS (SELECT *, {', '.join(_ops)} FROM o
  WINDOW t AS (PARTITION BY tab_id {_o}), h AS (PARTITION BY host {_o}), g AS ({_o})),
f AS (SELECT v.*, c.idle_enabled, c.tab_switch_enabled, c.share_enabled, c.enabled AS master_on,
    coalesce(share_off, false) AND coalesce(share_off_at > quiet_at, true) AS halted,
    coalesce(share_tab, false) AND coalesce(share_tab_at > reset_at, true) AS left_out
  FROM v JOIN (SELECT page_id, idle_enabled, tab_switch_enabled, share_enabled, enabled FROM {CFG}) c ON c.page_id = v.tab_id)
SELECT event_id, tab_id, seq, happened, idle_phase, coalesce(tp, 'off') AS tab_phase, master_on, all_open > 0 AND halted AS share_suspended,
  master_on AND idle_enabled AND NOT coalesce(idle_off, false) AND idle_phase IN ('idle', 'locked') AND NOT coalesce(idle_tab, false)
    AND NOT coalesce(idle_site, false) AS idle_on,
  master_on AND tab_switch_enabled AND NOT coalesce(switch_off, false) AND coalesce(tp = 'fired', false) AND NOT coalesce(switch_tab, false)
    AND NOT coalesce(switch_site, false) AS tab_on,
  master_on AND share_enabled AND all_open > 0 AND own_open = 0 AND NOT halted AND NOT left_out AND NOT coalesce(share_site, false) AS share_on
FROM f)"""
SQL["trigger_timeline"] = f"SELECT * EXCLUDE (seq, happened), {stamp('happened')} AS happened_at FROM {TIMELINE}"
SQL["trigger_notices"] = f"""
WITH w AS (SELECT *, lag(idle_phase) OVER o AS was_idle, lag(tab_phase) OVER o AS was_tab, coalesce(lag(share_on) OVER o, false) AS was_share,
  count_if(master_on) OVER o AS seen FROM {TIMELINE} WINDOW o AS (PARTITION BY tab_id ORDER BY happened, event_id, seq)),
l AS (SELECT *, CASE WHEN NOT master_on THEN [CASE WHEN was_share THEN 'share_dismiss' END] WHEN seen > 1 THEN [
  CASE WHEN idle_on AND idle_phase <> was_idle AND idle_phase <> 'active' AND NOT share_on THEN 'idle_show'
    WHEN NOT idle_on AND was_idle <> 'active' AND idle_phase = 'active' AND NOT share_on THEN 'idle_dismiss' END,
  CASE WHEN tab_on AND tab_phase <> was_tab AND tab_phase = 'fired' THEN 'tab_show' END,
  CASE WHEN share_on AND NOT was_share THEN 'share_show' WHEN NOT share_on AND was_share THEN 'share_dismiss' END,
  CASE WHEN NOT share_on AND was_share AND share_suspended THEN 'share_suspended' END] END AS found FROM w)
SELECT event_id, tab_id, {stamp('happened')} AS happened_at, unnest(list_filter(found, lambda x: x IS NOT NULL)) AS notice FROM l"""
SQL["notify_targets"] = f"""
SELECT t.tab_id, (SELECT count(*) FROM {E} e WHERE e.kind = 'share_close') + (SELECT count(*) FROM {E} e
  WHERE e.kind = 'share_open' AND e.tab_id <> t.tab_id) AS notices FROM (SELECT DISTINCT tab_id FROM {E}) t"""
SQL["url_change_debounce"] = """
WITH s AS (SELECT * FROM (SELECT event_id, ts, user_id AS tab_id, event_type AS url, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt
  FROM events) WHERE nxt IS NULL OR nxt >= ts + INTERVAL 3600 SECOND)
SELECT event_id, tab_id, url FROM (SELECT *, lag(url) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS was FROM s)
WHERE url IS DISTINCT FROM was"""
SQL["latest_text"] = "SELECT conv_id, role, md5(arg_max(text, turn)) AS text_md5 FROM conversations GROUP BY conv_id, role"
