"""The registered queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

QUERIES: dict = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


@query("op1_site_templates")
def site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .site_templates import extract_main_text
    out = extract_main_text(read(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op3_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay in the largest document only."""
    from .line_runs import drop_repeated_lines
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op5_link_trust")
def link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every url."""
    from .link_trust import judge_urls
    return judge_urls(read(spark, sf_dir, "pages"))


@query("op4_warc")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed archives and read back."""
    from .warc import read_archives, write_archives
    manifest = write_archives(read(spark, sf_dir, "pages"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by character models of the documents outside the held-out fold."""
    from .language_id import identify_held_out
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_held_out(docs).select("row.doc_id", "held_out", "lang_pred", "score", "bits", "accepted")


@query("op6_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    from .toxicity import score_held_out
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_held_out(docs, read(spark, sf_dir, "labels")).select("row.doc_id", "held_out", "score", "predicted")


@query("op7_cross_polytope")
def cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    from .cross_polytope import nearest
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op8_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by their three-word shingles."""
    from .jaccard_join import join_sets
    out = join_sets(read(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


@query("op9_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 8192 bytes."""
    from .packing import pack
    return pack(read(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query("op10_decontaminate")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold, and where."""
    from .decontaminate import find_items
    found = find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "score", "first_word", "last_word")


@query("op11_filter_audit")
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, per source, in each of their 120 orders."""
    from .filter_audit import audit
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op12_ranked_search")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    from .ranked_search import search
    found = search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@query("op13_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base numbers of every document and the verdict of rules weighed by their learned accuracies."""
    from .quality_rules import judge
    found = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
