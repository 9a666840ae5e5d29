"""SQL for the timing statistics."""

from __future__ import annotations

SQL: dict[str, str] = {}
S = ("(SELECT 'f' || (user_id % 4) AS fixture, event_type AS state, event_id AS iter, "
     "CASE WHEN event_id % 11 <> 3 THEN value END AS value FROM events)")


def rnd(x: str, digits: int = 0) -> str:
    scale = f"{10.0 ** digits}::DOUBLE"
    return f"floor(({x}) * {scale} + 0.5) / {scale}"


def nearest(p: float, value: str = "value") -> str:
    """The sample at the nearest rank, taken by its position in the ordered list."""
    return f"list_sort(list({value}) FILTER ({value} IS NOT NULL))[CAST(least(ceil(count({value}) * {p}::DOUBLE), count({value})) AS INT)]"


def summary(src: str, keys: str) -> str:
    return (f"SELECT {keys}, count(value) AS n, coalesce(min(value), 0) AS min, coalesce({nearest(0.5)}, 0) AS p50, "
            f"coalesce({nearest(0.95)}, 0) AS p95, coalesce(max(value), 0) AS max, coalesce({rnd('avg(value)')}, 0) AS mean "
            f"FROM {src} GROUP BY {keys}")


SQL["latency_summary"] = summary(S, "fixture, state")
SQL["latency_empty"] = summary(
    f"(SELECT fixture, state, CASE WHEN state <> 'error' THEN value END AS value FROM {S})", "state")
SQL["inp_p98"] = f"SELECT fixture, {nearest(0.98)} AS inp, count(value) AS inp_count FROM {S} GROUP BY fixture"
SQL["trend_slope"] = (
    f"SELECT fixture, state, CASE WHEN count(value) >= 2 THEN coalesce({rnd('regr_slope(value, x)', 3)}, 0) END AS slope "
    f"FROM (SELECT *, CAST(iter % 500 AS DOUBLE) AS x FROM {S}) GROUP BY fixture, state")
SQL["sample_stddev"] = f"SELECT fixture, state, {rnd('stddev_samp(value)', 1)} AS stddev FROM {S} GROUP BY fixture, state"
SQL["mean_and_series"] = (
    f"SELECT user_id, event_type AS state, event_id AS iter, value, "
    f"{rnd('avg(value) OVER (PARTITION BY user_id, event_type)', 1)} AS mean FROM events")
SQL["delta_vs_base"] = f"""
WITH m AS (SELECT fixture, state, {rnd('avg(value)', 1)} AS mean FROM {S} GROUP BY 1, 2)
SELECT a.fixture, a.state, {rnd('a.mean - b.mean', 1)} AS delta FROM m a LEFT JOIN m b ON b.fixture = a.fixture AND b.state = 'view'
WHERE a.state <> 'view'"""
SQL["pct_change"] = f"""
SELECT fixture, CASE WHEN b <> 0 THEN {rnd('(a - b) / b * 100', 1)} END AS pct, CAST(NULL AS DOUBLE) AS pct_zero
FROM (SELECT fixture, max(value) FILTER (state = 'view') AS a, max(value) FILTER (state = 'click') AS b FROM {S} GROUP BY fixture)"""
SQL["throughput"] = (
    f"SELECT fixture, state, {rnd('count(value) / max(value)', 1)} AS per_ms, CAST(NULL AS DOUBLE) AS none FROM {S} GROUP BY 1, 2")
_p95 = summary(f"(SELECT fixture, state, CASE WHEN NOT (fixture = 'f2' AND state = 'error') THEN value END AS value FROM {S})", "fixture, state")
SQL["budget_check"] = (
    "SELECT fixture, state, CASE WHEN n = 0 THEN 'N/A' WHEN p95 <= coalesce(MAP {'f0': 95.0, 'f1': 60.0, 'f2': 80.0}[fixture], 'infinity'::DOUBLE) "
    f"THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({_p95})")
SQL["budget_derive"] = f"""
WITH p AS ({summary(S, 'fixture, state')})
SELECT fixture, {rnd("coalesce(max(p95) FILTER (state = 'purchase'), max(p95) FILTER (state = 'signup'), "
                     "max(p95) FILTER (state = 'view'), max(p95) FILTER (state = 'click')) * 1.25")} AS budget
FROM p GROUP BY fixture"""
