"""Statistics over timing samples, by nearest rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.windows import nearest_rank


def js_round(x: Column, digits: int = 0) -> Column:
    """Halves go up, as the reference statistics round."""
    scale = 10.0 ** digits
    return F.floor(x * scale + 0.5) / scale


def summary(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, min, p50, p95, max and rounded mean; all zero for a group without samples."""
    v = F.col(value)

    def zero(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0))
    plain = samples.groupBy(*keys).agg(
        F.count(v).alias("n"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max"),
        zero(js_round(F.avg(v))).alias("mean"))
    ranked = nearest_rank(samples, keys, value, {"p50": 0.5, "p95": 0.95})
    return plain.join(ranked, keys, "left").select(
        *keys, "n", "min", zero(F.col("p50")).alias("p50"), zero(F.col("p95")).alias("p95"), "max", "mean")


def inp(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """98th percentile by nearest rank and the number of samples."""
    counts = samples.groupBy(*keys).agg(F.count(value).alias("inp_count"))
    return counts.join(nearest_rank(samples, keys, value, {"inp": 0.98}), keys, "left")


def trend(samples: DataFrame, keys: list[str], iteration: str = "iter", value: str = "value",
          digits: int = 3) -> DataFrame:
    """Least-squares slope per iteration: null below two samples, zero without spread."""
    slope = F.regr_slope(value, iteration)
    return samples.groupBy(*keys).agg(
        F.when(F.count(value) >= 2, F.coalesce(js_round(slope, digits), F.lit(0.0))).alias("slope"))


def spread(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return samples.groupBy(*keys).agg(js_round(F.stddev_samp(value), 1).alias("stddev"))


def series(samples: DataFrame, keys: list[str], value: str = "value", digits: int = 1) -> DataFrame:
    """The raw series, one row per sample, next to the mean of its group."""
    means = samples.groupBy(*keys).agg(js_round(F.avg(value), digits).alias("mean"))
    return samples.join(means, keys)


def delta(means: DataFrame, keys: list[str], state: str, base: str, digits: int = 1) -> DataFrame:
    """Difference to the base state; null where either side is missing."""
    b = means.where(F.col(state) == base).select(*keys, F.col("mean").alias("base_mean"))
    return means.where(F.col(state) != base).join(b, keys, "left").select(
        *keys, state, js_round(F.col("mean") - F.col("base_mean"), digits).alias("delta"))


def pct_change(a: Column, b: Column) -> Column:
    return F.when(b != 0, js_round((a - b) / F.when(b != 0, b) * 100, 1))


def throughput(count: Column, ms: Column) -> Column:
    return F.when((count != 0) & (ms > 0), js_round(count / F.when(ms > 0, ms), 1))


def budget_check(p95: Column, budget: Column) -> Column:
    return F.when(p95.isNull(), "N/A").when(budget.isNull() | (p95 <= budget), "PASS").otherwise("FAIL")


def budget_derive(p95_by_state: dict[str, Column], preference: list[str]) -> Column:
    """1.25 times the p95 of the first state, in order of preference, that has one."""
    return js_round(F.coalesce(*[p95_by_state[s] for s in preference]) * V.BUDGET_MULTIPLIER)
