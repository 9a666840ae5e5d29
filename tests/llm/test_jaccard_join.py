"""Similarity join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import jaccard_join as J
from maskwright.llm.components import components

SCHEMA = "doc_id long, text string"


def shingles(text, size):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}


def plain(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def texts(seed, groups=12, copies=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 3)))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 20, 60, 150]))]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w += [word() for _ in range(rng.randint(1, 6))]
            text = " ".join(w)
            rows.append((rng.randint(0, 5000), text.upper() if rng.random() < 0.1 and "É" not in text else text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, size, percent, block, lists", [
    (1, 3, 90, 1 << 20, 512), (2, 5, 80, 1 << 20, 2), (3, 3, 80, 300, 1), (4, 2, 70, 50, 4)])
def test_components_equal_all_pairs(spark, seed, size, percent, block, lists):
    rows = texts(seed)
    got = J.join_sets(spark.createDataFrame(rows, SCHEMA).repartition(2), settings=J.Settings(size, percent, block, lists))
    assert sorted(((r.key, r.n_shingles, r.component_id) for r in got.collect()), key=str) == plain(rows, size, percent)


@pytest.mark.parametrize("lists", [1, 4, 8, 30, 64])
def test_every_two_sets_of_a_long_list_meet_once(spark, lists):
    rng = np.random.default_rng(lists)
    rows = [(int(s), int(f), 10, 0, *range(len(J.SKETCHES))) for s in (5, -7) for f in rng.integers(-2**62, 2**62, 30)]
    listed = spark.createDataFrame(rows, f"shingle long, f long, n int, pos int, {J.SKETCH_FIELDS}")
    met = {}
    made = J.dealt(listed, J.Settings(list_sets=lists)).select("shingle", "own", "f").collect()
    for key in {r.shingle for r in made}:
        inside = [(r.f, r.own) for r in made if r.shingle == key]
        for x, (a, p) in enumerate(inside):
            for b, q in inside[:x]:
                if p < 0 or p != q:
                    met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    assert met == {(min(a[1], b[1]), max(a[1], b[1])): 1 for k, a in enumerate(rows) for b in rows[:k] if a[0] == b[0]}
    assert len(made) == len(rows) or lists < 30


def test_candidates_hold_every_pair_that_can_match(spark):
    rng = np.random.default_rng(8)
    settings = J.Settings(3, 80, list_sets=2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 30)).astype(np.uint64)) for _ in range(40)]
    rows = []
    for k, s in enumerate(sets):
        length = len(s) - (80 * len(s) + 99) // 100 + 1
        rows += [(int(x), k, len(s), i, *(1000 * k + j for j in range(len(J.SKETCHES)))) for i, x in enumerate(s[:length])]
    listed = spark.createDataFrame(rows, f"shingle long, f long, n int, pos int, {J.SKETCH_FIELDS}").repartition(3)
    found = {(r.a, r.b) for r in J.candidates(J.dealt(listed, settings), settings).collect()}
    for b in range(40):
        for a in range(b):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in found


def test_nulls_ties_repeats_long_texts_and_clashes(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (5, "A  B"), (6, "a b c"), (None, "a b"), (None, "only null"), (None, "only null"),
            (7, "x " * 100_000), (8, "X " * 90_000), (9, "a b"), (9, "p q r s")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "version", "row", "f", "n", "block", "root"):
        df = df.withColumn(name, df.text)
    got = sorted(((r.key, r.n_shingles, r.component_id) for r in J.join_sets(df).collect()), key=str)
    assert got == plain(rows, 3, 90)
    kept = J.keep_one(df)
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 6, None, 7, 9], key=str)
    assert set(kept.columns) == set(df.columns)
    assert J.join_sets(df.limit(0)).count() == 0 and J.keep_one(df.limit(0)).count() == 0


def test_stars_of_long_chains(spark):
    rng = random.Random(0)
    nodes = list(range(200))
    rng.shuffle(nodes)
    edges = [(nodes[k], nodes[k + 1]) for k in range(199) if k not in (50, 120)] + [(300, 300), (301, 302), (302, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in (nodes[:51], nodes[51:121], nodes[121:], [301, 302]):
        assert {got[x] for x in part} == {min(part)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_equal_sets_give_one_posting_a_list(spark):
    sc, settings = spark.sparkContext, J.Settings()
    rank, every = sc.broadcast(np.zeros(1 << J.SKETCH_BITS, np.int8)), sc.broadcast(np.full(1 << (J.MAP_BITS - 6), 0xFFFFFFFFFFFFFFFF, np.uint64))
    text = " ".join(f"w{k}" for k in range(30))
    for ids in (lambda k: k, lambda k: 1):  # copies of many ids, and one row many times
        rows = [(ids(k), text) for k in range(90)] + [(ids(k + 90), text.upper()) for k in range(10)] + [(100, text + " more")]
        rows = spark.createDataFrame(rows, "key long, text string").repartition(4).withColumn("version", F.xxhash64("text")).select("key", "version", "text")
        sets = J.describe(rows, settings).where("kind = 0")
        reps = sets.groupBy("f").agg(F.min(F.struct("key", "version")).alias("rep")).select("f", "rep.key", "rep.version")
        made = J.postings(J.class_texts(reps, sets, rows), rank, every, settings)
        assert made.count() == made.select("shingle", "f").distinct().count() and made.select("f").distinct().count() == 2


def test_parities_differ_at_most_as_much_as_sets(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    texts_ = []
    for k in range(40):
        mine = list(base)
        for _ in range(rng.choice([0, 1, 5, 20, 100, 300])):
            mine[rng.randrange(len(mine))] = rng.choice(words)
        texts_.append(" ".join(mine[:rng.choice([3, 60, 70, 260, 300])]))
    settings = J.Settings(3, 80)
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts_)], "key long, version long, text string")
    reps = J.describe(rows, settings).where("kind = 0").groupBy("f").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.first("parity").alias("parity"))
    reps = reps.cache()
    held = {r.f: set(zip(*[texts_[r.key].split()[i:] for i in range(3)])) for r in reps.collect()}
    every = [(a, b) for a in held for b in held if a < b]
    kept = {(r.a, r.b) for r in J.not_apart(spark.createDataFrame(every, "a long, b long"), reps, settings).collect()}
    for a, b in every:
        shared = len(held[a] & held[b])
        if 100 * shared >= 80 * len(held[a] | held[b]):
            assert (a, b) in kept
        if min(len(held[a]), len(held[b])) > 200 and 2 * shared < len(held[a] | held[b]):
            assert (a, b) not in kept
    assert kept
