"""Registered queries: SQL twins and the pipeline's stages."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from maskwright import llm

SQL = llm.all_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_all_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in llm.all_queries()} == {f"op{k}" for k in range(1, 14)}
    assert set(llm.all_queries()) <= names and "pipeline" in names and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    df = llm.all_queries()[name](spark, sf)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert check.rows(df.columns, df.collect()) == check.rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name, columns", [
    ("op2_language_id", ["doc_id", "held_out", "lang_pred", "score"]), ("op6_toxicity", ["doc_id", "held_out", "score", "predicted"]),
    ("op7_cross_polytope", ["query_id", "rank", "vec_id", "score"]), ("op9_packing", ["doc_id"]), ("op10_decontaminate", ["doc_id", "item_id"]),
    ("op13_quality_rules", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])])
def test_columns_of_the_others(spark, sf, name, columns):
    df = llm.all_queries()[name](spark, sf)
    assert df.columns[:len(columns)] == columns
    assert df.count() > 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gone = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "12 34", "en", "s", 5), (None, "of the and thing", "en", "s", 16)], docs.schema)
    now = docs.unionByName(gone).withColumn("row", F.lit("x"))
    sizes = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, sf)
        if name != "packing":
            assert now.columns == before.columns
        sizes.append(now.select("doc_id").distinct().count())
    assert sizes[0] == 203 and sizes[1] == 201 and all(a >= b for a, b in zip(sizes, sizes[1:]))
    assert sizes[3] < sizes[2] and sizes[4] < sizes[3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_the_whole_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "bin_id", "bin_offset"] and out.count() > 50
