"""Filter interaction audit: the walk and the whole audit against filters applied one after the other."""

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from maskwright.llm import filter_audit

DOCS = "doc_id long, text string, source string, `before` string, `mask` int"
LABELS = "doc_id long, quality int, toxic int"
PROSE = " ".join(f"w{k}" for k in range(60))


def fails(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    return out


def brute(rows, labels):
    rows = [(d, t or "", s or "") for d, t, s, *_ in rows]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    failing = [fails(t) | ({"E"} if d is not None and any(o is not None and o < d and u == t for o, u, _ in rows) else set())
               for d, t, _ in rows]
    out = {}
    for part in {s for _, _, s in rows}:
        mine = [k for k, r in enumerate(rows) if r[2] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in failing[k]]
                left = [k for k in left if f not in failing[k]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in failing[k] for k in mine) - len(gone), sum(failing[k] == {f} for k in mine),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, rows, labels):
    found = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len({(r.part, r.filter_order, r.step) for r in found})
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}


def test_audit_with_nulls_repeats_and_clashing_names(spark):
    texts = [None, "", "   ", PROSE, PROSE, PROSE + " # x", PROSE.upper(), "A b " * 40, "one two", "x" * 200_000, PROSE + "\n\x0b|", "É" * 30 + " A"]
    rows = [(k * 7 % 5 if k % 4 else None, texts[k % len(texts)], ["a", "b", None, ""][k % 4], "x", k) for k in range(40)]
    rows += [(100 + k, PROSE, "hot", "x", 0) for k in range(30)] + [(3, PROSE, "hot", "x", 0)] * 3
    labels = [(k, k % 3, k % 2) for k in range(4)] + [(3, 1, None), (101, None, 1), (None, 1, 1), (5_000, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    assert audited(spark, [(1, "a", "s", "", 0)], []) == brute([(1, "a", "s", "", 0)], [])


def test_the_walk_gives_the_survivors_of_every_subset():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, (3, 32, 2))
    alive = filter_audit.gray_walk(counts, 5)
    for subset in range(32):
        assert (alive[:, subset] == counts[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


def test_identical_texts_of_many_parts(spark):
    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit(PROSE).alias("text"), (F.col("id") % 100).cast("string").alias("source"))
    found = filter_audit.audit(rows, spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' AND step = 1")
    assert {(r.part, r.kept, r.removed) for r in found.collect()} == {(str(k), int(k == 0), 30 - int(k == 0)) for k in range(100)}
