"""Merged sketches against exact counts."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from maskwright.operators import sketches


def test_merged_months_are_near_the_exact_count(spark, sf):
    """Four standard errors, and the findings exactly."""
    got = {r.detector: r for r in entry.queries()["distinct_values_sketch"](spark, sf).collect()}
    found = entry.queries()["scan_probes"](spark, sf).groupBy("detector").agg(
        F.count("*").alias("n"), F.countDistinct("hit").alias("d")).collect()
    assert {r.detector: (r.n, r.d, True) for r in found} == {k: (r.findings, r.distinct_values, r.near) for k, r in got.items()}


def test_cells_overlap_nulls_and_nothing(spark):
    rows = [(k % 7, "a", f"v{k % 5000}") for k in range(20_000)] + [(1, "b", None), (1, "c", "x"), (2, "c", "x"), (None, "c", "x")]
    cells = sketches.value_sketches(spark.createDataFrame(rows, "day int, detector string, hit string"), ["day", "detector"])
    got = {r.detector: (r.findings, r.distinct_values) for r in sketches.distinct_over(cells, ["detector"]).collect()}
    assert got["b"] == (1, 0) and got["c"] == (3, 1) and got["a"][0] == 20_000 and abs(got["a"][1] - 5000) < 325
    span = sketches.distinct_over(cells.where("day between 1 and 2"), []).first()
    exact = len({k % 5000 for k in range(20_000) if k % 7 in (1, 2)}) + 1
    assert span.findings == sum(k % 7 in (1, 2) for k in range(20_000)) + 3 and abs(span.distinct_values - exact) < 0.065 * exact
    assert sketches.distinct_over(cells.limit(0), ["detector"]).count() == 0
    assert tuple(sketches.distinct_over(cells.limit(0), []).first()) == (0, 0)
