"""Decontamination against alignment of every text with every item."""

import random
import re

import numpy as np

from maskwright.llm import decontaminate as D

SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_scores_equal_the_plain_table():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64)
        score, start, end = D.align(a, b)
        assert score == smith_waterman(a, b)
        assert smith_waterman(a, b[start:end]) == score
    assert D.align(a, np.zeros(0, np.uint64))[0] == 0


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    common = [word() for _ in range(40)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(12, 40))).capitalize() + ".") for k in range(15)]
    docs, planted = [], set()
    for d in range(300):
        w = text(rng.randint(5, 200))
        if d % 3 == 0:
            k = rng.randrange(15)
            copy = re.findall(r"\w+", items[k][1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([[word()], [], [copy[at], word()]])
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.1 else x for x in copy]
            planted.add((d, k))
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    return docs, items, planted


def test_planted_copies_are_found_and_clean_texts_stay(spark):
    docs, items, planted = corpus()
    found = D.find_items(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.key, r.item) for r in found} == planted
    plain = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    text, item = dict(docs), dict(items)
    for r in found:
        a = plain(item[r.item])
        b = plain(text[r.key])[r.first_word:r.last_word + 1]
        assert abs(r.score - smith_waterman(a, b) / (2 * len(a))) < 1e-9
        assert abs(r.score - smith_waterman(a, plain(text[r.key])) / (2 * len(a))) < 1e-9


def test_blocks_of_items_find_the_same(spark):
    docs, items, planted = corpus(5)
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    assert {(r.key, r.item) for r in D.find_items(d, b, settings=D.Settings(block_words=50)).collect()} == planted


def test_an_item_copied_everywhere_keeps_its_seeds(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank today"
    docs = [(k, f"text {k} begins {item} and number {k} ends") for k in range(200)] + [(500, "the lazy dog sleeps"), (501, "quick brown foxes")]
    got = D.find_items(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, item)], ITEMS))
    assert {r.key for r in got.collect()} == set(range(200))


def test_nulls_short_items_repeats_long_texts_and_clashes(spark):
    item = " ".join(f"word{k}" for k in range(20))
    docs = [(1, None), (2, ""), (None, item), (None, item), (3, item), (3, item), (4, "yes"), (5, "x " * 200_000 + item), (6, "no alpha beta no")]
    items = [(1, item), (2, None), (3, ""), (4, "alpha beta"), (None, "gamma delta epsilon zeta"), (1, item), (5, "!!")]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    for name in ("key", "version", "row", "item", "score"):
        d, b = d.withColumn(name, d.text), b.withColumn(name, b.text)
    got = sorted(((r.key, r.item, r.score) for r in D.find_items(d, b).collect()), key=str)
    assert got == sorted([(None, 1, 1.0), (3, 1, 1.0), (5, 1, 1.0), (6, 4, 1.0)], key=str)
    kept = D.drop_contaminated(d, b)
    assert sorted((r.row.doc_id for r in kept.collect()), key=str) == [1, 2, 4]
    assert D.find_items(d.limit(0), b).count() == 0 and D.find_items(d, b.limit(0)).count() == 0
    assert D.drop_contaminated(d, b.limit(0)).count() == len(docs)


def test_copies_in_several_documents_are_found_as_one_alone_is(spark):
    item = [f"word{k}" for k in range(40)]
    edited = " ".join(f"other{k}" if k % 5 == 2 else w for k, w in enumerate(item))
    half, rest = " ".join(item[:20]), " ".join(item[20:])
    for copies in (1, 3, 60):
        for copy in (edited, half):
            docs = [(k, f"text {k} begins {copy} and ends {k}") for k in range(copies)] + [(900, "nothing of it")]
            got = D.find_items(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, " ".join(item))], ITEMS))
            assert {r.key for r in got.collect()} == set(range(copies))
    docs = [(k, half) for k in range(60)] + [(100, f"{half} {rest}"), (101, f"some {rest}")]  # frequent seeds only in most copies
    got = D.find_items(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, " ".join(item))], ITEMS))
    assert {r.key for r in got.collect()} == {*range(60), 100, 101}


def test_every_third_word_changed_added_or_left_out_is_found_from_the_threshold_on(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, items, expected = [], [], set()
    for k in range(40):
        item = [word() for _ in range(rng.randint(12, 45))]
        items.append((k, " ".join(item)))
        changed = [word() if i % 3 == k % 3 else w for i, w in enumerate(item)]
        added = [x for i, w in enumerate(item) for x in ([w, word()] if i % 2 else [w])]
        out = [w for i, w in enumerate(item) if i % 4 != k % 4]
        for n, copy in enumerate((changed, added, out)):
            d = 10 * k + n
            docs.append((d, " ".join([word() for _ in range(30)] + copy + [word() for _ in range(30)])))
            if smith_waterman(item, docs[-1][1].split()) >= len(item):
                expected.add((d, k))
    got = D.find_items(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    assert len({d % 10 for d, _ in expected}) == 3 and len(expected) > 90
    assert {(r.key, r.item) for r in got} == expected


def test_seeds_meet_with_a_word_more_or_less():
    words = np.arange(1, 6, dtype=np.uint64)
    assert D.shapes(3) == [(0, 1, 2), (0, 2, 3), (0, 1, 3)] and D.shapes(1) == [(0,)]
    row, gap = D.runs(words[[0, 1, 3]], (0, 1, 2), 3), D.runs(words, (0, 1, 3), 3)
    assert row[0] == gap[0] and len(gap) == 2 and len(D.runs(words[:1], (0, 1, 2), 3)) == 0
