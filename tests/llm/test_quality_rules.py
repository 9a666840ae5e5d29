"""Quality by weak supervision: the base numbers and the estimates against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskwright.llm import quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = len(covered)
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, failed)


def judged(spark, rows):
    found = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words string")).collect()
    return {r.row.doc_id: r for r in found}


def test_base_numbers(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a " * 9, "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x\n\nx\n x\nx\r", "É#*$%&|<> \x0b\x0c 日本",
             "a b c d e f g h i a b c d e f g h i j", "z" * 100_000, "😀 " * 30, "<p>" * 40, "A\n" * 30]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["\n".join(" ".join(rng.choice("abcdef") for _ in range(rng.randrange(4))) for _ in range(20)) for _ in range(20)]
    texts += [" ".join(rng.choice(["the", "of", "and", "x"]) for _ in range(20_000))]
    found = judged(spark, [(k, t, "x", "y") for k, t in enumerate(texts)])
    for k, t in enumerate(texts):
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        assert r.row.kept == "x" and r.row.n_words == "y"
        assert not (r.kept and r.base_failed)


def test_equals_sf_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in quality_rules.judge(docs.select("doc_id", "text")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.row.doc_id])


def test_estimates_equal_a_plain_version(spark):
    rng = random.Random(2)
    rules = tuple(quality_rules.Rule(x, "true", "false") for x in "abcd")
    votes = quality_rules.vote_columns(rules)
    rows = []
    for _ in range(2_000):
        good = rng.random() < 0.7
        rows.append([0 if rng.random() < 0.2 else (1 if (rng.random() < (0.95 if good else 0.3)) else -1) for _ in rules])
    counted = Counter(map(tuple, rows))
    table = spark.createDataFrame([(*v, n) for v, n in counted.items()], ", ".join(f"{v} int" for v in votes) + ", n long")
    made = quality_rules.learned(table, rules, settled=1e-7, prior=0.02)
    share, on_good, on_bad = 0.8, [0.98] * 4, [0.6] * 4
    for _ in range(400):
        sums = [[0.0] * 4 for _ in rules]
        total = 0.0
        for v, n in counted.items():
            odds = math.log(share / (1 - share))
            for x, g, b in zip(v, on_good, on_bad):
                odds += {1: math.log(g / (1 - b)), -1: math.log((1 - g) / b), 0: 0}[x]
            q = 1 / (1 + math.exp(-odds))
            total += n * q
            for s, x in zip(sums, v):
                if x:
                    s[0 if x > 0 else 1] += n * q
                    s[2 if x > 0 else 3] += n * (1 - q)
        new = []
        for yes_good, no_good, yes_bad, no_bad in sums:
            weight = 0.02 * (yes_good + no_good + yes_bad + no_bad)
            new.append(((yes_good + 0.98 * weight) / (yes_good + no_good + weight), (no_bad + 0.6 * weight) / (yes_bad + no_bad + weight)))
        share = (total + 0.01 * len(rows)) / (1.02 * len(rows))
        on_good, on_bad = [x for x, _ in new], [x for _, x in new]
    assert made.share == pytest.approx(share, abs=1e-4)
    assert made.right_on_good == pytest.approx(on_good, abs=1e-4) and made.right_on_bad == pytest.approx(on_bad, abs=1e-4)


def test_finds_junk_and_keeps_prose(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality_rules.judge(docs.select("doc_id", "text")).select("row.doc_id", "kept", "base_failed").join(labels, "doc_id")
    counts = {(r.quality, r.kept): r.n for r in found.where("NOT base_failed").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert counts[1, True] >= 0.99 * (counts[1, True] + counts.get((1, False), 0))
    assert counts.get((0, False), 0) >= 0.9 * (counts.get((0, True), 0) + counts.get((0, False), 0))


def test_no_python_in_the_plan_and_empty_tables(spark):
    rows = spark.createDataFrame([], "doc_id long, text string, kept string, n_words string")
    assert quality_rules.judge(rows).count() == 0
    plan = spark.createDataFrame([("a",)], "text string").select(quality_rules.signals(F.col("text")).alias("s"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
