"""Control events derived from the event stream.

Every user is a tab. Clicks and views move the focus, purchases and errors
open and close shared streams, sign-ups change the ignore lists and the
suspended triggers. Plain SQL that both engines understand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
_KIND = (
    "CASE event_type WHEN 'click' THEN CASE WHEN k % 10 = 0 THEN 'lock' ELSE 'focus' END "
    "WHEN 'view' THEN 'hide' WHEN 'purchase' THEN 'share_open' WHEN 'error' THEN 'share_close' "
    "ELSE CASE k % 6 WHEN 0 THEN 'ignore_tab' WHEN 1 THEN 'unignore_tab' WHEN 2 THEN 'ignore_site' "
    "WHEN 3 THEN 'unignore_site' WHEN 4 THEN 'suspend' ELSE 'resume' END END"
)
_TRIGGER = "CASE CAST(floor(k / 6) AS INT) % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'tab_switch' ELSE 'screen_share' END"
COLUMNS = {
    "event_id": "event_id",
    "ts": "ts",
    "tab_id": "user_id",
    "host": "'h' || CAST(user_id % 20 AS STRING) || '.example.com'",
    "kind": _KIND,
    "stream_id": "CASE WHEN event_type IN ('purchase', 'error') THEN 's' || CAST(k % 4 AS STRING) END",
    "trigger": "CASE WHEN event_type = 'signup' THEN " + _TRIGGER + " END",
}
_BASE = f"SELECT *, {_K} AS k FROM events"
SELECT_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + f" FROM ({_BASE})"

_V1 = ("'{\"active\":' || CASE WHEN c_custkey % 4 = 0 THEN 'false' ELSE 'true' END || ',\"sharing_tab_id\":' || "
       "CASE WHEN c_custkey % 6 = 3 THEN 'null' ELSE CAST(c_custkey AS STRING) END || ',\"started_at\":' || "
       "CAST(1700000000000 + c_custkey AS STRING) || ',\"suppressed_sites\":[\"a.com\",\"\"]}'")
_V2 = ("'{\"' || CAST(c_custkey AS STRING) || '\":{\"started_at\":' || CAST(1700000000000 + c_custkey AS STRING) || "
       "',\"suppressed_sites\":[\"b.com\"]},\"x9\":{\"started_at\":5},\"77\":{\"started_at\":\"soon\"}}'")
_V3 = ("'{\"' || CAST(c_custkey AS STRING) || '\":{\"streams\":{\"p1\":{\"started_at\":' || CAST(1700000000000 + c_custkey AS STRING) || "
       "'},\"p2\":{\"started_at\":null},\"p3\":{\"started_at\":7}}},\"88\":{\"streams\":{}}}'")
RECORD_SQL = (f"CASE c_custkey % 5 WHEN 0 THEN {_V1} WHEN 1 THEN {_V2} WHEN 2 THEN {_V3} WHEN 3 THEN 'null' ELSE {_V1} END")


def _timestamp(df):
    # Session time zone is UTC, so the cast keeps the clock reading.
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def control_events(spark, sf_dir: str):
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def from_events(events):
    """Control events of any event DataFrame, streaming or not."""
    base = _timestamp(events).selectExpr("*", f"{_K} AS k")
    return base.selectExpr(*[f"{v} AS {k}" for k, v in COLUMNS.items()])


def share_records(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS owner", f"{RECORD_SQL} AS record")
