"""Bucketed ordered computations against the plain ones, with one hot key."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from maskwright.functions import windows as W
from maskwright.operators import latency, sessions
from maskwright.streaming import scan as stream_ops
from maskwright.streaming import sessions as stream_sessions

c = F.col


def key():
    return Window.partitionBy("k").orderBy("t", "i")


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice(["hot"] * 4 + ["a", "b", None]), rnd.randint(0, 400), rnd.choice([None, 1, 2, 3])) for i in range(3000)]
    return spark.createDataFrame(rows, "i int, k string, t int, v int").cache()


def same(a, b, *cols):
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert b.select(*cols).exceptAll(a.select(*cols)).count() == 0


def test_previous(data):
    bucket = F.floor(c("t") / 10)
    same(W.previous(data, ["k"], bucket, ["t", "i"], c("v"), "p"), data.withColumn("p", F.lag("v").over(key())), "i", "k", "p")
    same(W.previous(data, ["k"], bucket, ["t", "i"], c("v"), "p", backward=True),
         data.withColumn("p", F.lead("v").over(key())), "i", "k", "p")


def test_running_sum(data):
    plain = data.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(key().rowsBetween(Window.unboundedPreceding, 0)))
    same(W.running_sum(data, ["k"], F.floor(c("t") / 7), ["t", "i"], F.coalesce("v", F.lit(0)), "s"), plain, "i", "k", "s")


def test_latest(data):
    v = F.when(c("v") == 2, c("i"))
    plain = data.withColumn("l", F.last(v, True).over(key().rowsBetween(Window.unboundedPreceding, 0)))
    same(W.latest(data, ["k"], F.floor(c("t") / 9), ["t", "i"], v, "l"), plain, "i", "k", "l")
    plain = data.withColumn("l", F.first(v, True).over(key().rowsBetween(1, Window.unboundedFollowing)))
    same(W.latest(data, ["k"], F.floor(c("t") / 9), ["t", "i"], v, "l", following=True), plain, "i", "k", "l")


def test_order_over_all_rows_in_levels(data):
    every = Window.partitionBy(F.lit(1)).orderBy("t", "i")
    levels = (lambda b: F.floor(b / 5), lambda b: F.floor(b / 4))
    bucket, v = F.floor(c("t") / 3), F.when(c("v") == 2, c("i"))
    plain = data.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(every.rowsBetween(Window.unboundedPreceding, 0)))
    same(W.running_sum(data, [], bucket, ["t", "i"], F.coalesce("v", F.lit(0)), "s", coarser=levels), plain, "i", "s")
    plain = data.withColumn("l", F.first(v, True).over(every.rowsBetween(1, Window.unboundedFollowing)))
    same(W.latest(data, [], bucket, ["t", "i"], v, "l", following=True, coarser=levels), plain, "i", "l")
    plain = data.withColumn("l", F.last(v, True).over(every.rowsBetween(Window.unboundedPreceding, 0)))
    same(W.latest(data, ["k"], bucket, ["t", "i"], v, "l", coarser=levels), data.withColumn(
        "l", F.last(v, True).over(key().rowsBetween(Window.unboundedPreceding, 0))), "i", "k", "l")
    same(W.latest(data, [], bucket, ["t", "i"], v, "l", coarser=levels), plain, "i", "l")


def test_nearest_rank_is_exact(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([1.0, 1.0, 5.5, rnd.random() * 1e6])) for _ in range(5000)] + [("one", 7.0)] \
        + [("few", float(x)) for x in range(1, 21)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r["k"]: r for r in latency.summary(df, ["k"]).collect()}
    for k in ("hot", "one", "few"):
        xs = sorted(v for key, v in rows if key == k)
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            assert got[k][name] == xs[min(math.ceil(len(xs) * q) - 1, len(xs) - 1)]
    assert got["few"]["p95"] == 19.0
    assert [got["none"][x] for x in ("n", "min", "p50", "p95", "max", "mean")] == [0, 0, 0, 0, 0, 0]


def test_rounding_and_guards(spark):
    row = spark.range(1).select(
        latency.js_round(F.lit(2.5)).alias("up"), latency.js_round(F.lit(-2.5)).alias("down"),
        latency.pct_change(F.lit(3.0), F.lit(0.0)).alias("zero"), latency.throughput(F.lit(0), F.lit(5.0)).alias("none"),
        latency.budget_check(F.lit(None).cast("double"), F.lit(5.0)).alias("na")).first()
    assert tuple(row) == (3.0, -2.0, None, None, "N/A")


def test_threshold_clamp():
    assert [sessions.clamp_threshold(x) for x in (None, 1, 60, 99999)] == [300, 15, 60, 3600]


EVENTS = "event_id long, ts timestamp, tab_id long, host string, kind string, stream_id string, trigger string"


def test_stream_sessions_over_many_batches(spark, tmp_path):
    """State carried over micro-batches gives the sessions of the whole."""
    rnd = random.Random(4)
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", rnd.choice([1, 1, 1, 2, 3]), "h", rnd.choice(["share_open", "share_close", "focus"]),
             f"s{rnd.randint(0, 2)}", None) for i in range(900)]
    df = spark.createDataFrame(rows, EVENTS.replace("ts timestamp", "ts string")).withColumn("ts", c("ts").cast("timestamp"))
    for part in range(3):
        df.where((c("event_id") >= part * 300) & (c("event_id") < part * 300 + 300)).coalesce(1).write.mode("append") \
            .parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_ops.run_to_end(stream_sessions.closed_shares(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = sessions.share_sessions(df).where("ended_at is not null").select(
        "tab_id", "started_at", "ended_at", c("max_streams").cast("int"), c("opens").cast("int"))
    same(got, want, "tab_id", "started_at", "ended_at", "max_streams", "opens")


def test_share_end_resumes_only_when_nobody_shares(spark):
    rows = [(1, "2024-01-01 00:00:01", 1, "h", "share_open", "s", None), (2, "2024-01-01 00:00:02", 2, "h", "share_open", "s", None),
            (3, "2024-01-01 00:00:03", 1, "h", "suspend", None, "screen_share"), (4, "2024-01-01 00:00:04", 1, "h", "share_close", "s", None)]
    def flags(rs):
        df = spark.createDataFrame(rs, EVENTS.replace("ts timestamp", "ts string")).withColumn("ts", c("ts").cast("timestamp"))
        return sessions.suspend_flags(df).first()["suspended"]
    assert flags(rows) is True
    assert flags(rows + [(5, "2024-01-01 00:00:05", 2, "h", "share_close", "s", None)]) is False


def test_replay_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in ([(1, "a", 2, "x"), (2, "b", 2, "y")], [(1, "a", 4, "z")], [(1, "a", 3, "old"), (3, "c", 2, "w")]):
        spark.createDataFrame(part, "id long, role string, turn long, text string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, role string, turn long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    stream_ops.run_to_end_whole(stream_ops.newest(stream, ["id", "role"], "turn"), str(tmp_path / "out"), str(tmp_path / "ck"))
    early = spark.createDataFrame([(1, "a", 1, "p"), (4, "d", 1, "q")], "id long, role string, turn long, text string")
    got = stream_ops.replay(early, spark.read.parquet(str(tmp_path / "out")), ["id", "role"], "turn")
    assert sorted((r.id, r.turn, r.text) for r in got.collect()) == [(1, 4, "z"), (2, 2, "y"), (3, 2, "w"), (4, 1, "q")]


def test_rows_put_in_order_are_shuffled_once(spark):
    df = spark.range(200).select((c("id") % 3).alias("k"), "id", (c("id") % 7).alias("v"))
    old = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        args = (df, ["k"], F.floor(c("id") / 10), ["id"])
        for made in (W.previous(*args, c("v"), "x"), W.running_sum(*args, c("v"), "x"), W.latest(*args, c("v"), "x"), W.latest_each(*args, {"x": c("v")})):
            # one of the rows, three of the rows of their buckets
            assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def test_rows_without_a_bucket_carry_nothing_and_null_keys_are_a_key(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 11, 6), (1, 2, 7), (1, None, 8), (1, 12, 9)], "k int, id int, v int")
    got = W.previous(df, ["k"], F.floor(c("id") / 10), ["id"], c("v"), "x", backward=True).collect()
    assert {(r["k"], r["id"], r["x"]) for r in got} == {(None, 1, 6), (None, 11, None), (1, 2, 9), (1, None, None), (1, 12, None)}
