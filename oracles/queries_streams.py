"""SQL for the streams: what the batch form of each gives."""

from __future__ import annotations

from maskwright.sources import control

from . import detection as D
from . import queries_detection as QD
from . import queries_pages as QP
from . import queries_sessions as QS

SQL: dict[str, str] = {}
SQL["stream_scan"] = QD.SQL["scan_probes"]
SQL["stream_page_scan"] = QP.SQL["page_scan"]
SQL["stream_text_changes"] = (
    "SELECT user_id % 10 AS page_id, user_id AS node_id, CASE event_type WHEN 'click' THEN 'childList' ELSE 'characterData' END AS op, "
    "'item ' || event_id AS text FROM events WHERE event_type IN ('click', 'view')")
SQL["stream_share_sessions"] = f"SELECT * FROM ({QS.SQL['share_sessions']}) WHERE ended_at IS NOT NULL"
_mark = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"
_dead = "INTERVAL 21600 SECOND"
SQL["stream_share_expiry"] = f"""
WITH g AS (SELECT *, sum(CASE WHEN ts > was + {_dead} THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS life
  FROM (SELECT *, lag(ts) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS was FROM {QS.E} WHERE ts <= {_mark})),
lives AS (SELECT tab_id, life, max(ts) AS seen FROM g GROUP BY tab_id, life),
s AS (SELECT *, CASE WHEN kind = 'share_open' THEN CASE WHEN prior = 'share_open' THEN 0 ELSE 1 END WHEN prior = 'share_open' THEN -1 ELSE 0 END AS step
  FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY tab_id, life, stream_id ORDER BY ts, event_id), '') AS prior FROM g
    WHERE kind IN ('share_open', 'share_close'))),
r AS (SELECT *, sum(step) OVER (PARTITION BY tab_id, life ORDER BY ts, event_id) AS n_open FROM s WHERE step <> 0),
n AS (SELECT *, sum(CASE WHEN step = 1 AND n_open = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id, life ORDER BY ts, event_id) AS no FROM r),
d AS (SELECT tab_id, life, no, min(ts) AS began, max(ts) FILTER (n_open = 0) AS closed, max(n_open) AS most, count_if(step = 1) AS opens
  FROM n GROUP BY tab_id, life, no)
SELECT tab_id, {QS.stamp('began')} AS started_at, {QS.stamp(f'coalesce(closed, seen + {_dead})')} AS ended_at,
  CAST(most AS INT) AS max_streams, CAST(opens AS INT) AS opens, closed IS NULL AS expired
FROM d JOIN lives USING (tab_id, life) WHERE closed IS NOT NULL OR seen + {_dead} <= {_mark}"""
SQL["stream_idle"] = f"""
WITH g AS (SELECT *, sum(CASE WHEN was IS NULL OR ts >= was + INTERVAL 3600 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events))
SELECT user_id AS tab_id, {QS.stamp('min(ts)')} AS began, {QS.stamp('max(ts) + INTERVAL 3600 SECOND')} AS idle_at, count(*) AS events
FROM g GROUP BY user_id, no HAVING max(ts) + INTERVAL 3600 SECOND <= {_mark}"""
_w = "TIMESTAMP '1970-01-01' + to_seconds(CAST(epoch(o_orderdate) AS BIGINT) // 2419200 * 2419200)"
SQL["stream_findings_per_window"] = f"""
WITH f AS (SELECT {_w} AS began, f.detector FROM ({QD.SQL['scan_probes']}) f JOIN orders o ON o.o_orderkey = f.id)
SELECT strftime(began, '%Y-%m-%d %H:%M:%S') AS began, detector, count(*) AS n FROM f
WHERE began + INTERVAL 28 DAY <= (SELECT max(o_orderdate) FROM orders JOIN (SELECT DISTINCT id FROM ({QD.SQL['scan_probes']})) ON id = o_orderkey) - INTERVAL 1 HOUR
GROUP BY 1, 2"""
_merged = "(SELECT conv_id AS id, role, max(turn) AS turn, arg_max(text, turn) AS text, CAST(NULL AS VARCHAR) AS country FROM conversations GROUP BY 1, 2)"
_keyed = f"(SELECT id * 10 + CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS id, text, country FROM {_merged})"
SQL["buffer_replay"] = f"""
SELECT m.id, m.role, m.turn, md5(m.text) AS text_md5, CAST(count(f.id) AS INT) AS n FROM {_merged} m
LEFT JOIN ({D.findings(_keyed)}) f ON f.id = m.id * 10 + CASE m.role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END
GROUP BY ALL"""
SQL["findings_stream_sink"] = QD.SQL["scan_probes"]
SQL["replay_log"] = f"SELECT id, role, turn, md5(text) AS text_md5 FROM {_merged}"
