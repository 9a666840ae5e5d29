"""The pipeline's stages against plain versions of them, each on what the stage before it kept."""

import pyarrow as pa

import corpus_pipeline
from maskwright.llm import decontaminate as D
from maskwright.llm.words import utf8
from test_jaccard_join import plain as plain_components
from test_line_runs import plain as plain_lines


def words(texts):
    hashes, first = D.plain_words(*utf8(pa.array(texts, pa.large_string())))
    return [hashes[a:b] for a, b in zip(first, first[1:])]


def test_stages_equal_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def held(df):
        return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    docs = stages["language_id"](spark, docs, sf).cache()
    texts = held(docs)
    assert texts == sorted((i, t) for i, t in held(spark.read.parquet(f"{sf}/documents.parquet")) if any(c.isalpha() for c in t))

    docs = stages["line_dedup"](spark, docs, sf).cache()
    texts = [(i, t) for i, t, *_ in plain_lines(texts) if t.strip()]
    assert held(docs) == sorted(texts)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    docs = stages["near_dedup"](spark, docs, sf).cache()
    root = {i: c for i, _, c in plain_components(texts, 5, 80)}
    texts = [(i, t) for i, t in texts if root[i] == i]
    assert held(docs) == sorted(texts)

    docs = stages["decontaminate"](spark, docs, sf).cache()
    items = words([r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    clean = [(i, t) for (i, t), w in zip(texts, words([t for _, t in texts]))
             if not any(D.align(item, w)[0] >= 0.5 * 2 * len(item) for item in items)]
    assert held(docs) == sorted(clean) and len(clean) < len(texts)

    out = stages["packing"](spark, docs, sf).collect()
    size = {}
    for r in out:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {i: len(t.encode()) for i, t in clean}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for b in {r.bin_id for r in out}:
        inside = [r for r in out if r.bin_id == b]
        assert sum(r.length for r in inside) <= 8192
        assert len({source[r.doc_id] for r in inside}) == len(inside) or len({r.doc_id for r in inside}) == 1
