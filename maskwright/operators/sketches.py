"""Counts of different values that can be kept and merged.

A sketch of a few kilobytes stands for the values of one cell (a day and a
detector, say). Cells are merged for any span without a look at the findings,
so a report over a year reads days times detectors rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers are two to this power; the relative error is about 1.04 / sqrt(registers), 1.6 % here.
PRECISION = 12


def bound(precision: int = PRECISION) -> float:
    """Four standard errors, relative."""
    return 4 * 1.04 / 2 ** (precision / 2)


def value_sketches(found: DataFrame, cells: list[str], value: str = "hit", precision: int = PRECISION) -> DataFrame:
    """(*cells, findings, sketch): nulls are counted as findings, not as values. Sketches are built before the shuffle."""
    return found.groupBy(*cells).agg(
        F.count("*").alias("findings"), F.hll_sketch_agg(F.col(value), F.lit(precision)).alias("sketch"))


def distinct_over(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, findings, distinct_values) of all cells that share ``keys``; no keys give one row."""
    merged = sketches.groupBy(*keys).agg(
        F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*keys, "findings", F.coalesce(
        F.hll_sketch_estimate("sketch"), F.lit(0)).alias("distinct_values"))
