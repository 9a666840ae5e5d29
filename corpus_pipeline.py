"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of ``documents``. Null and empty
texts leave at the first stage; extra columns are carried along by all but the
last; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, jaccard_join, language_id, line_runs, packing
from maskwright.llm.shared import read, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the language models accept."""
    found = language_id.identify_held_out(docs)
    return found.where("accepted").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one; the text and n_chars are those of what stays.

    A document that is left without a word goes.
    """
    kept = line_runs.drop_repeated_lines(docs)
    fields = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    kept = kept.where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles from a similarity of 0.8 on, the smallest id."""
    return jaccard_join.keep_one(docs, settings=jaccard_join.Settings(words=5, percent=80))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset): sequences of 8192 bytes."""
    return packing.pack(docs).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmarks),
    ("packing", packed),
]

#: Character models, connected components, alignment and best-fit order are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each one's result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
