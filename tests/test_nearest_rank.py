"""Quantiles by refinement are those of the sorted values, at any bound."""

import math
import random

import pytest

from maskwright.functions import windows as W

WANTED = {"p01": 0.01, "p50": 0.5, "p98": 0.98, "most": 1.0}


@pytest.mark.parametrize("bound", [3, 100, 1_000_000])
def test_quantiles_at_any_bound(spark, bound):
    rnd = random.Random(bound)
    rows = [("hot", rnd.gauss(0, 1)) for _ in range(6000)] + [("ties", float(rnd.choice([1, 1, 1, 2, 5]))) for _ in range(900)]
    rows += [("one", 4.0), ("none", None)] + [("mixed", rnd.choice([0.0, rnd.random(), float("nan")])) for _ in range(2000)]
    got = {r.k: r.asDict() for r in W.nearest_rank(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", WANTED, bound).collect()}
    assert set(got) == {"hot", "ties", "one", "mixed"}
    for key, found in got.items():
        values = sorted((x for k, x in rows if k == key), key=lambda x: (math.isnan(x), x))
        for name, q in WANTED.items():
            want = values[math.ceil(len(values) * q) - 1]
            assert found[name] == want or math.isnan(found[name]) and math.isnan(want), (key, name)
