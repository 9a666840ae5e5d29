"""Toxicity: hashes, held-out texts, misspellings, odd input."""

import numpy as np
import pyarrow as pa
import pytest

from maskwright.llm import toxicity as T
from maskwright.llm.words import utf8

SMALL = T.Settings(buckets=1 << 14)


def make(rng, words, toxic, bad, n):
    out = [str(rng.choice(words)) for _ in range(n)]
    if toxic:
        out[int(rng.integers(n))] = str(rng.choice(bad))
    return " ".join(out)


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(120)]
    bad = ["zweckwoz", "kwazzik", "wozzig"]
    return [(k, make(rng, words, k % 3 == 0, bad, int(rng.integers(8, 60))), int(k % 3 == 0)) for k in range(1500)], words


def scores(texts, model):
    return T.score_texts(*utf8(pa.array(texts, pa.large_string())), model)


def test_subwords_do_not_depend_on_what_stands_around():
    def bags(text):
        w = T.words_of(*utf8(pa.array(text)))
        out = [set() for _ in w.starts]
        for at, bucket in T.subwords(w, 1 << 30):
            for a, b in zip(np.searchsorted(w.starts, at, "right") - 1, bucket):
                out[a].add(int(b))
        return out
    alone, amid = bags(["Idiot"])[0], bags(["ü x", "", "an idiot!", "idiots"])
    assert alone == amid[3] and len(alone) == 5 + 4 + 3 + 1
    assert len(alone & amid[4]) == 4 + 3 + 2


def test_scores_do_not_depend_on_the_batch(labelled):
    rows, _ = labelled
    model = T.fit(pa.array([t for _, t, _ in rows], pa.large_string()), np.array([y for *_, y in rows]), SMALL)
    texts = [t for _, t, _ in rows[:40]] + ["", None, "!!"]
    assert np.allclose(scores(texts, model), np.concatenate([scores([t], model) for t in texts]), atol=1e-5)
    assert scores(["", None, "!!"], model).tolist() == [0, 0, 0]


def test_held_out_texts_misspellings_and_long_texts(spark, labelled):
    rows, words = labelled
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    truth = {k: y for k, _, y in rows}
    got = [r for r in T.score_held_out(docs, labels, settings=SMALL).collect() if r.held_out]
    assert len(got) > 100
    assert np.mean([r.predicted == truth[r.row.doc_id] for r in got]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    model = T.fit(pa.array([t for _, t, _ in rows], pa.large_string()), np.array([y for *_, y in rows]), SMALL)
    clean = " ".join(words[:50])
    bad, worse, plain, long = scores([clean + " kwazzikk " + clean, clean + " Zweckwozz", clean, (clean + " ") * 200 + "kwazzik " + clean], model)
    assert min(bad, worse, long) > 0.7 > plain


def test_nulls_one_label_repeats_clashes_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "word " * 300_000)], "doc_id long, text string")
    for name in ("row", "score", "predicted", "held_out", "key"):
        docs = docs.withColumn(name, docs.text)
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None), (3, 7)], "doc_id long, toxic int")
    for labels in (one, one.limit(0)):
        got = T.score_held_out(docs, labels, settings=SMALL).collect()
        assert len(got) == 6 and not any(r.held_out for r in got if r.row.doc_id is None)
        assert {r.score for r in got if not r.row.text} == {0.0}
    assert T.score_held_out(docs.limit(0), one, settings=SMALL).collect() == []
    many = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    tied = spark.createDataFrame([(k, "same words") for k in range(50)], "doc_id long, text string")
    assert len({round(r.score, 6) for r in T.score_held_out(tied, many, settings=SMALL).collect()}) == 1
