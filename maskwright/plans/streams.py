"""Streams run to their end; each must equal its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.arrays import with_once
from ..operators import resolve
from ..sources import control, probes, rich_pages, tables
from ..streaming import ledger
from ..streaming import scan as stream_scan_ops
from ..streaming import sessions as stream_sessions
from .pages import scan_pages
from .registry import query

c = F.col


def _finished(spark, stream, name):
    base = tables.scratch(spark, f"{name}-{uuid.uuid4().hex}")
    stream_scan_ops.run_to_end(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("stream_scan")
def stream_scan(spark, sf_dir):
    """Probe texts scanned as a stream of files."""
    units = probes.from_orders(stream_scan_ops.source(spark, sf_dir, "orders"))
    return _finished(spark, stream_scan_ops.scan_stream(units), "stream-scan")


@query("stream_page_scan")
def stream_page_scan(spark, sf_dir):
    """Pages scanned node by node as a stream of files, each under its own country."""
    pages = rich_pages.enriched(stream_scan_ops.source(spark, sf_dir, "pages"))
    return _finished(spark, scan_pages(pages), "stream-pages")


@query("stream_text_changes")
def stream_text_changes(spark, sf_dir):
    """Changes of text in a stream, each delivered once; other changes are ignored."""
    events = stream_scan_ops.source(spark, sf_dir, "events").select(
        (c("user_id") % 10).alias("page_id"), c("user_id").alias("node_id"), c("ts").cast("timestamp").alias("ts"),
        F.when(c("event_type") == "click", "childList").when(c("event_type") == "view", "characterData")
        .otherwise("attributes").alias("op"), F.concat(F.lit("item "), c("event_id").cast("string")).alias("text"))
    twice = with_once(events, copy=F.lit(0)).unionByName(with_once(events, copy=F.lit(1))).drop("copy")
    return _finished(spark, stream_scan_ops.text_changes(twice), "stream-changes").select(
        "page_id", "node_id", "op", "text")


@query("stream_share_sessions")
def stream_share_sessions(spark, sf_dir):
    """Finished sharing sessions from keyed state."""
    events = control.from_events(stream_scan_ops.source(spark, sf_dir, "events"))
    return _finished(spark, stream_sessions.closed_shares(events), "stream-shares").select(
        "tab_id", c("started_at").cast("string"), c("ended_at").cast("string"), "max_streams", "opens")


@query("stream_share_expiry")
def stream_share_expiry(spark, sf_dir):
    """Sharing sessions that were closed, or whose tab was silent for six hours."""
    events = control.from_events(stream_scan_ops.source(spark, sf_dir, "events"))
    with stream_sessions.keyed_state(spark):
        ended = _finished(spark, stream_sessions.ended_shares(events, 21600), "stream-expiry")
    return ended.select("tab_id", c("started_at").cast("string"), c("ended_at").cast("string"), "max_streams", "opens", "expired")


@query("stream_idle")
def stream_idle(spark, sf_dir):
    """Stretches of activity that the watermark has closed."""
    events = control.from_events(stream_scan_ops.source(spark, sf_dir, "events"))
    return _finished(spark, stream_sessions.activity(events, 3600), "stream-idle").select(
        "tab_id", c("began").cast("string"), c("idle_at").cast("string"), "events")


@query("stream_findings_per_window")
def stream_findings_per_window(spark, sf_dir):
    """Findings of the probe texts per year window, closed by the watermark."""
    orders = stream_scan_ops.source(spark, sf_dir, "orders")
    units = probes.from_orders(orders, ts=c("o_orderdate").cast("timestamp"))
    found = resolve.with_matches(units).select("ts", F.explode("m").alias("m")).select("ts", "m.detector")
    return _finished(spark, stream_sessions.findings_per_window(found, "28 days"), "stream-windows").select(
        c("began").cast("string"), "detector", "n")


@query("buffer_replay")
def buffer_replay(spark, sf_dir):
    """A first scan of the early turns; the later ones arrive as a stream and are replayed on top, newest per speaker kept."""
    def turns(df):
        return df.select(c("conv_id").alias("id"), "role", "turn", "text", F.lit(None).cast("string").alias("country"))
    late = turns(stream_scan_ops.source(spark, sf_dir, "conversations", per_trigger=1)).where("turn >= 2")
    newest = stream_scan_ops.newest(late, ["id", "role"], "turn")
    base = tables.scratch(spark, f"replay-{uuid.uuid4().hex}")
    stream_scan_ops.run_to_end_whole(newest, f"{base}/out", f"{base}/checkpoint")
    changes = spark.read.schema(newest.schema).parquet(f"{base}/out")
    early = turns(tables.read(spark, sf_dir, "conversations")).where("turn < 2")
    merged = stream_scan_ops.replay(early, changes, ["id", "role"], "turn")
    return resolve.with_matches(merged).select("id", "role", "turn", F.md5("text").alias("text_md5"), F.size("m").alias("n"))


@query("findings_stream_sink")
def findings_stream_sink(spark, sf_dir):
    """Findings of the probe texts written by a stream, each batch once, a folder per detector, and read back."""
    found = stream_scan_ops.scan_stream(probes.from_orders(stream_scan_ops.source(spark, sf_dir, "orders")))
    base = tables.scratch(spark, f"findings-stream-{uuid.uuid4().hex}")
    ledger.run_to_end(found, f"{base}/out", f"{base}/checkpoint", "detector")
    return ledger.rows(spark, f"{base}/out", found.schema, "detector").drop("batch")


@query("replay_log")
def replay_log(spark, sf_dir):
    """Newest turn per speaker from a log of changes, compacted once."""
    turns = stream_scan_ops.source(spark, sf_dir, "conversations", per_trigger=1).select(
        c("conv_id").alias("id"), "role", "turn", "text")
    path, keys = tables.scratch(spark, f"replay-log-{uuid.uuid4().hex}"), ["id", "role"]
    ledger.log_changes(turns, path, f"{path}/checkpoint", keys, "turn")
    ledger.compact(spark, path, turns.schema, keys, "turn", batches=1)
    return ledger.current(spark, path, turns.schema, keys, "turn").select("id", "role", "turn", F.md5("text").alias("text_md5"))
