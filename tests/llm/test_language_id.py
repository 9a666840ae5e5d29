"""Language models: codes, probabilities, held-out accuracy, rejection, odd input."""

import numpy as np
import pyarrow as pa
import pytest

from maskwright.llm import language_id as L
from maskwright.llm.words import characters, utf8


def codes(*texts):
    points, at = characters(*utf8(pa.array(list(texts))))
    made, at = L.ngram_codes(points, at)
    return [made[a:b].tolist() for a, b in zip(at, at[1:])]


def test_codes_stay_within_words_and_texts():
    def code(*symbols):
        return sum(ord(s) << (16 * i) if s else 0 for i, s in enumerate(symbols))
    got = codes("Ab, c1", "", "12", "é")
    assert got[0] == [code("a"), code("b", "a"), code(0, "b", "a"), code("c"), code(0, "c")]
    assert got[1] == got[2] == [] and got[3] == [code("é"), code(0, "é")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    words = {"aa": ["nolo", "milo", "sano", "tano"], "bb": ["strk", "krst", "grst", "trsk"]}
    rows = []
    for k in range(400):
        lang = "aa" if k % 2 else "bb"
        rows.append((k, " ".join(rng.choice(words[lang], 6)) + ".", lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_probabilities_add_up_to_one(docs):
    model = L.train(docs, "text", "lang")
    seen = sorted({c & 0xFFFF for t in ("nolo milo sano tano strk krst grst trsk",) for c in codes(t)[0]})
    for context in (0, ord("o"), ord("l") | ord("o") << 16):
        every = np.array([s | context << 16 for s in range(1 << 16)], np.int64)
        p = 2.0 ** -model.bits(every)
        known = p[:, seen]
        rest = np.median(np.delete(p, seen, axis=1), axis=1)  # a few unseen symbols share the hash of a seen n-gram
        assert np.allclose(known.sum(axis=1) + rest * (p.shape[1] - len(seen)), 1, atol=1e-2)
    assert len(seen) > 5


def test_held_out_rows_are_found_and_noise_is_rejected(spark, docs):
    noise = spark.createDataFrame([(1000, "qqqqxq wwxwqz zzqxw qwx zqxwq xqzwx", None), (1001, "1234 !!", "aa"), (1002, None, "aa"),
                                   (1003, "", None), (None, "nolo sano", None), (1004, "strk " * 200_000, None)], docs.schema)
    got = {r.row.doc_id: r for r in L.identify_held_out(docs.unionByName(noise)).collect()}
    assert all(got[k].lang_pred == ("aa" if k % 2 else "bb") and got[k].accepted for k in range(400))
    assert any(got[k].held_out for k in range(400)) and not got[None].held_out
    assert not got[1000].accepted and got[1004].lang_pred == "bb"
    for k in (1001, 1002, 1003):
        assert (got[k].lang_pred, got[k].score, got[k].accepted) == ("und", 0.0, False)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_the_fold_are_not_learned(spark, docs):
    from pyspark.sql import functions as F
    held = L.fold(F.col("doc_id"), 4) == 2
    other = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    a = {r.row.doc_id: (r.lang_pred, r.score) for r in L.identify_held_out(docs).collect()}
    b = {r.row.doc_id: (r.lang_pred, r.score) for r in L.identify_held_out(other).collect()}
    assert a == b


def test_repeats_ties_clashes_and_empty_tables(spark, docs):
    twice = docs.limit(3).unionByName(docs.limit(3))
    for name in ("row", "lang_pred", "score", "accepted", "bits", "held_out"):
        twice = twice.withColumn(name, twice.text)
    assert L.identify_held_out(twice).count() == 6
    assert L.identify_held_out(docs.limit(0)).collect() == []
    none = docs.selectExpr("doc_id", "text", "cast(null as string) lang").limit(2)
    assert {(r.lang_pred, r.score) for r in L.identify_held_out(none).collect()} == {("und", 0.0)}
    same = spark.createDataFrame([(1, "ab ab", "x"), (3, "ab ab", "y"), (5, "ab", None)], docs.schema)
    kept = L.train(same, "text", "lang")
    assert L.identify(same, kept).where("row.doc_id = 5").first().lang_pred == "x"


def test_every_ngram_has_its_own_entry(spark):
    letters = [chr(0x4E00 + k) for k in range(3000)]
    rng = np.random.default_rng(8)
    rows = [(k, " ".join("".join(rng.choice(letters, 3)) for _ in range(60)), "cc") for k in range(300)]
    rows += [(1000 + k, "nolo milo sano tano", "aa") for k in range(20)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang")
    seen = np.unique(np.concatenate(codes(*(t for _, t, lang in rows if lang == "cc"))))
    assert np.array_equal(model.grams["cc", L.ORDER][0], seen)
    for order in range(1, L.ORDER + 1):  # n-grams that were never seen have no probability of their own
        keys, values = model.grams["cc", order]
        other = np.setdiff1d(keys + 1_048_573, keys)
        assert (L._find((keys, values), other, 0.0) == 0).all()
        assert np.isclose(values.sum() if order == 1 else 0, 1 - model.contexts["cc", 1][1][0] if order == 1 else 0, atol=1e-3)


def test_letters_of_all_planes_and_marks(spark, docs):
    assert codes("\U0001F600 \U0001F603", "\u0301", " \u0301a", "a\u0301\u0302", "\U00020000", "\U00010428\U0001D400") != [[]] * 6
    got = codes("\U0001F600\U0001F603", "\u0301", " \u0301a", "a", "\U00020000", "\U00010428", "e\u0301\u0302")
    assert got[0] == got[1] == [] and got[2] == got[3] and got[4] and got[5] and got[4] != got[5] and len(got[6]) == 4
    rows = spark.createDataFrame([(1, "\U0001F600 \U0001F603!", "aa"), (2, "\u0301", "aa"), (3, "1\u0301 \u0308", "aa"), (4, "nolo\u0301", "aa")], docs.schema)
    found = {r.row.doc_id: (r.lang_pred, r.score) for r in L.identify_held_out(docs.unionByName(rows)).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] == "aa"


def test_pieces_give_the_codes_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(1)
    parts = ["ab", "é", "\u0301", " ", "-", "\n", "日本", "x" * 40, "\U0001F600", "\U00020000", ""]
    texts = ["".join(rng.choice(parts, int(n))) for n in rng.integers(0, 400, 40)] + [None, "", "y" * 5_000]
    whole = codes(*[t or "" for t in texts])
    for size in (1, 7, 64, 1_000):
        monkeypatch.setattr(L, "PIECE", size)
        got = [[] for _ in texts]
        for a, b, made, at in L.text_codes(pa.array(texts, pa.string())):
            for k in range(a, b):
                got[k] += made[at[k - a]:at[k - a + 1]].tolist()
        assert got == whole
