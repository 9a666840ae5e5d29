"""Queries over timing samples taken from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latency
from ..sources import tables
from .registry import query

c = F.col

BUDGETS = {"f0": 95.0, "f1": 60.0, "f2": 80.0}


def samples(spark, sf_dir):
    """Events as samples: fixture by user, state by event type, a gap now and then."""
    return tables.read(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), (c("user_id") % 4).cast("string")).alias("fixture"),
        c("event_type").alias("state"), c("event_id").alias("iter"),
        F.when(c("event_id") % 11 != 3, c("value")).alias("value"))


@query("latency_summary")
def latency_summary(spark, sf_dir):
    return latency.summary(samples(spark, sf_dir), ["fixture", "state"])


@query("latency_empty")
def latency_empty(spark, sf_dir):
    """A group whose samples are all missing sums up to zeros."""
    gaps = samples(spark, sf_dir).withColumn("value", F.when(c("state") != "error", c("value")))
    return latency.summary(gaps, ["state"])


@query("inp_p98")
def inp_p98(spark, sf_dir):
    return latency.inp(samples(spark, sf_dir), ["fixture"])


@query("trend_slope")
def trend_slope(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("iter", (c("iter") % 500).cast("double"))
    return latency.trend(s, ["fixture", "state"])


@query("sample_stddev")
def sample_stddev(spark, sf_dir):
    return latency.spread(samples(spark, sf_dir), ["fixture", "state"])


@query("mean_and_series")
def mean_and_series(spark, sf_dir):
    """Every sample with the mean of its run, a run being one user's events of a kind."""
    runs = tables.read(spark, sf_dir, "events").select(
        "user_id", c("event_type").alias("state"), c("event_id").alias("iter"), "value")
    return latency.series(runs, ["user_id", "state"]).select("user_id", "state", "iter", "value", "mean")


@query("delta_vs_base")
def delta_vs_base(spark, sf_dir):
    means = samples(spark, sf_dir).groupBy("fixture", "state").agg(
        latency.js_round(F.avg("value"), 1).alias("mean"))
    return latency.delta(means, ["fixture"], "state", "view")


@query("pct_change")
def pct_change(spark, sf_dir):
    totals = samples(spark, sf_dir).groupBy("fixture").agg(
        F.max(F.when(c("state") == "view", c("value"))).alias("a"),
        F.max(F.when(c("state") == "click", c("value"))).alias("b"))
    return totals.select("fixture", latency.pct_change(c("a"), c("b")).alias("pct"),
                         latency.pct_change(c("a"), F.lit(0.0)).alias("pct_zero"))


@query("throughput")
def throughput(spark, sf_dir):
    totals = samples(spark, sf_dir).groupBy("fixture", "state").agg(
        F.count("value").alias("n"), F.max("value").alias("ms"))
    return totals.select("fixture", "state", latency.throughput(c("n"), c("ms")).alias("per_ms"),
                         latency.throughput(c("n") * 0, c("ms")).alias("none"))


@query("budget_check")
def budget_check(spark, sf_dir):
    """Verdicts by fixture and state; one group has gaps only and is N/A, one fixture has no budget."""
    budgets = spark.createDataFrame(list(BUDGETS.items()), "fixture string, budget double")
    gaps = samples(spark, sf_dir).withColumn("value", F.when(~((c("fixture") == "f2") & (c("state") == "error")), c("value")))
    p95 = latency.summary(gaps, ["fixture", "state"]).withColumn("p95", F.when(c("n") > 0, c("p95")))
    return p95.join(F.broadcast(budgets), "fixture", "left").select(
        "fixture", "state", latency.budget_check(c("p95"), c("budget")).alias("verdict"))


@query("budget_derive")
def budget_derive(spark, sf_dir):
    states = ["purchase", "signup", "view", "click"]
    p95 = latency.summary(samples(spark, sf_dir), ["fixture", "state"])
    wide = p95.groupBy("fixture").pivot("state", states).agg(F.max("p95"))
    return wide.select("fixture", latency.budget_derive({s: c(s) for s in states}, states).alias("budget"))
