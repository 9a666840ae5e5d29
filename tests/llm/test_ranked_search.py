"""Ranked search: whole results against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from maskwright.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string, pos int", "item_id long, text string, doc_id string"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    held = [(d, terms(t)) for d, t, *_ in docs]
    held = [(d, ts, Counter(ts)) for d, ts in held if ts]
    n, total = len(held), sum(len(ts) for _, ts, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for name, text in {(i, t or "") for i, t, *_ in items}:
        scores = []
        for d, ts, c in held:
            m = 10 + (90 * len(ts) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(name, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    rows = ranked_search.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k).collect()
    return sorted(((r.item, r.rank, r.doc, r.score) for r in rows), key=str)


@pytest.fixture
def small(monkeypatch):
    # every bound is met many times on a small table
    monkeypatch.setattr(ranked_search, "BUNDLE_ITEMS", 3)
    monkeypatch.setattr(ranked_search, "BATCH_ITEMS", 7)
    monkeypatch.setattr(ranked_search, "OWNER_PAIRS", 25)


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["É1", "日本", "The", "THE"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(80))), "s", 1) for k in range(300)]
    docs += [(None, "w1 w2 w3", "", 0), (7, "w1 w2 w3", "", 0), (7, "w1 w2 w3", "", 0), (900, None, "", 0), (901, "", "", 0), (902, " ,.-", "", 0)]
    items = [(k, ", ".join(rng.choices(vocabulary, k=rng.randrange(1, 20))), "x") for k in range(15)]
    items += [(3, "w1 w1 W1", "x"), (3, "w1 w1 W1", "y"), (50, None, ""), (51, "nowhere", ""), (None, "w5, w6", "")]
    return docs, items


def test_equals_plain_scores(spark):
    docs, items = made(1)
    assert found(spark, docs, items) == brute(docs, items)


def test_many_owners_bundles_and_batches(spark, small):
    docs, items = made(2)
    assert found(spark, docs, items, 4) == brute(docs, items, 4)


def test_ties_and_a_term_of_all_documents(spark):
    docs = [(k, "a b" if k % 2 else "a", "", 0) for k in range(40)]
    items = [(1, "a", ""), (2, "a b", "")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = made(3)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None, "", 0)], items) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "abc dé " * 50_000 + "x" * 30_000
    whole = [h for hashes, _, _ in ranked_search.term_pieces(pa.array([text, None, "abc"])) for h in hashes.tolist()]
    monkeypatch.setattr(ranked_search, "PIECE", 1_000)
    cut = list(ranked_search.term_pieces(pa.array([text, None, "abc"])))
    assert [h for hashes, _, _ in cut for h in hashes.tolist()] == whole and len(whole) == 100_002 and len(cut) > 300
    assert [complete for _, _, complete in cut].count(True) == 2 and cut[-1][1].tolist() == [2]
