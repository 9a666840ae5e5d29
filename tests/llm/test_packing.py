"""Packing: capacity, conflicts, completeness, tightest compatible bin."""

import random

from maskwright.llm import packing as P


def plain(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(room, k) for k, (room, ss, cc) in enumerate(bins) if room >= n and (s is None or s not in ss) and (c is None or c not in cc)]
        if fits:
            _, k = min(fits)
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        out.append((k, capacity - bins[k][0]))
        bins[k][0] -= n
        bins[k][1].add(s)
        bins[k][2].add(c)
    return out


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(0, 60)
        lengths = sorted((rng.randint(1, 20) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, 0, 1, 2, 3]) for _ in range(n)]
        clusters = [rng.choice([None, *range(20)]) for _ in range(n)]
        assert P.best_fit(lengths, sources, clusters, 20) == plain(lengths, sources, clusters, 20)


def test_rows_are_whole_and_bins_keep_the_rules(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("abé ") for _ in range(rng.choice([1, 10, 30, 90, 250]))), rng.choice(["hot", "hot", "a", "b", None])) for k in range(400)]
    rows += [(900, None, "a"), (901, "", "a"), (902, "x" * 1000, "a"), (902, "x" * 1000, "a"), (None, "hello", None), (903, "Copy  me", "c"), (904, "copy me ", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("key", "cluster", "length", "shard", "row", "piece"):
        df = df.withColumn(name, df.text)
    got = P.pack(df, capacity=100, shard_rows=150).collect()
    size = {}
    for i, t, _ in rows:
        size[i] = size.get(i, 0) + len((t or "").encode())
    total, bins = {}, {}
    for r in got:
        total[r.key] = total.get(r.key, 0) + r.length
        assert (r.bin_id is None) == (r.length == 0)
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    assert total == size
    source = {i: s for i, _, s in rows}
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in held:
            assert r.bin_offset == at and r.start == r.piece * 100
            at += r.length
        assert at <= 100
        named = [source[r.key] for r in held if source[r.key] is not None]
        assert len(named) == len(set(named))
    of = {r.key: r.bin_id for r in got}
    assert of[903] != of[904]
    assert P.pack(df.limit(0)).count() == 0


def test_long_texts_and_own_lengths(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "b", "a")], "doc_id long, text string, source string")
    got = P.pack(df, capacity=8192).collect()
    assert sum(r.length for r in got if r.key == 1) == 600_000
    words = P.pack(df, length=F.size(F.split("text", " ")), capacity=1000).collect()
    assert sum(r.length for r in words if r.key == 1) == 300_001
