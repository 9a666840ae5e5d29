"""Nearest vectors against brute force."""

import numpy as np
from pyspark.sql import functions as F

from maskwright.llm import cross_polytope as C

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 50 == 0:
            best = {}
            for i, y in good:
                if i != q and len(y) == len(x):
                    best[i] = max(best.get(i, -2), float(x @ y / np.sqrt((x @ x) * (y @ y))))
            out[q] = sorted(((-round(s, 12), i) for i, s in best.items()))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
    return out


def test_hadamard_keeps_lengths_and_hashes_are_nearest_axes():
    x = np.random.default_rng(0).normal(size=(5, 6))
    for turned in C.rotations(x, C.Tables(3)):
        assert turned.shape == (5, 8) and np.allclose((turned ** 2).sum(1), (x ** 2).sum(1), rtol=1e-4)
        axis = C.nearest_axis(turned)
        assert ((turned[np.arange(5), axis // 2] < 0) == (axis % 2 == 1)).all()


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=64).astype(np.float32).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, want = found(C.nearest(df, df.where("vec_id % 50 = 0"), block=7)), brute(rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, i): s for q, v in brute(rows, 2000).items() for s, i in v}
    assert all(abs(exact[q, i] - s) < 1e-9 for q, v in got.items() for s, i in v)


def test_copies_tie_to_the_smaller_id_and_none_is_lost(spark):
    base = np.random.default_rng(5).normal(size=16).astype(np.float32).tolist()
    rows = [(k, base) for k in range(400)] + [(1000, [-x for x in base])]
    got = found(C.nearest(*(lambda df: (df, df.where("vec_id % 50 = 0")))(spark.createDataFrame(rows, SCHEMA).repartition(4))))
    assert [i for _, i in got[0]] == [1, 2, 3, 4, 5] and [i for _, i in got[300]] == [0, 1, 2, 3, 4]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (50, None), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [2.0, 0.0]), (150, [3.4e38, 3.4e38])]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "vector", "hashes", "score", "rank", "query_id"):
        df = df.withColumn(name, F.lit(1))
    got = found(C.nearest(df, df.where("vec_id % 50 = 0"), tables=C.Tables(16, 8)))
    assert set(got) == {0, 100, 150}
    assert [i for _, i in got[0]][:2] == [1, 150] and len(got[0]) == len({i for _, i in got[0]})
    assert C.nearest(df.limit(0), df.limit(0)).count() == 0


def test_repeats_do_not_push_out_other_neighbours(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    rows = [(k, (base + 0.05 * k * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(12)]
    for more in ([rows[1]] * 20, rows * 2):  # one row many times, every row three times
        df = spark.createDataFrame(rows + list(more), SCHEMA).coalesce(1)
        assert found(C.nearest(df, df.where("vec_id % 50 = 0"))) == brute(rows)


def test_queries_have_all_candidates_where_there_are_few(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=64).astype(np.float32).tolist()
    rows = [(0, base), (1, [-x for x in base]), *((k, [-x * k for x in base]) for k in (2, 4)), (5, [1.0, 2.0, 3.0]), (50, [-1.0, -2.0, -3.0])]
    rows += [(100 + 50 * k, rng.normal(size=128).astype(np.float32).tolist()) for k in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, want = found(C.nearest(df, df.where("vec_id % 50 = 0"), block=4)), brute(rows)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_very_large_and_very_small_components(spark):
    rng = np.random.default_rng(4)
    plain = [(i, rng.normal(size=8)) for i in range(120)]
    power = lambda i: (1.0, 2.0 ** 665, 2.0 ** -900)[i % 3]
    rows = [(i, (v * power(i)).tolist()) for i, v in plain] + [(200, [5e-324] + [0.0] * 7), (201, [1.7e308] * 8)]
    got = found(C.nearest(*[spark.createDataFrame(rows, "vec_id long, embedding array<double>")] * 2).where("query_id % 50 = 0"))
    same = [(i, v.tolist()) for i, v in plain] + [(200, [1.0] + [0.0] * 7), (201, [1.0] * 8)]
    want = brute(same)
    assert got == want
    assert all(-1.0 <= -s <= 1.0 + 1e-9 for best in got.values() for s, _ in best)


def test_scaling_leaves_every_cosine_as_it_was():
    x = np.random.default_rng(5).normal(size=(50, 16))
    cosine = lambda m: np.einsum("ij,j->i", m, m[0]) / (np.sqrt(np.einsum("ij,ij->i", m, m)) * np.sqrt(m[0] @ m[0]))
    assert (cosine(C.scaled(x)) == cosine(x)).all()
