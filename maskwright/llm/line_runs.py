"""Line dedup over levelled sorted runs of line hashes.

A run is a table sorted by line hash: hash, number of documents, largest
document. Runs are kept in levels; when a level holds ``fanout`` runs they are
merged into one run of the next level. A new batch is merge-anti-joined with
the settled lines of the runs (lines known from enough documents whose largest
holder is larger than the batch's document): such rows cannot change a count
that matters or a holder, so they add nothing. What is left is added as a run.
Batches may come in any order; the merged counts are then at least
``min_docs`` exactly where the true ones are, and the holders are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANK_CHARS, ascii_lower, shared_folder, stored, whole_rows


def text_lines(text: Column) -> Column:
    """Lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANK_CHARS)))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, version, pos): every line whose key has at least ``min_chars`` code points.

    ``h1, h2`` are 128 bits of the key; ``version`` tells rows with one id but different texts apart.
    """
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("version"),
                        F.posexplode(text_lines(F.col(text_col))).alias("pos", "line"))
    keyed = lines.select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc", "version", "pos")


class LineRuns:
    """Runs of (h1, h2, docs, holder) in levels below a shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        path = shared_folder(self.spark, f"line-run-{level}")
        rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def entries(self, paths: list[str] | None = None) -> DataFrame | None:
        """Merged runs: one row per hash."""
        paths = [p for level in self.levels for p in level] if paths is None else paths
        if not paths:
            return None
        return self.spark.read.parquet(*paths).groupBy("h1", "h2").agg(
            F.sum("docs").alias("docs"), F.max("holder").alias("holder"))

    def settled(self) -> DataFrame | None:
        """Hashes known from at least ``min_docs`` documents."""
        merged = self.entries()
        return None if merged is None else merged.where(F.col("docs") >= self.min_docs).select("h1", "h2", "holder")

    def add(self, batch: DataFrame) -> None:
        """Add the rows (h1, h2, doc) of documents that no earlier batch held."""
        batch = batch.where(F.col("doc").isNotNull()).select("h1", "h2", "doc").distinct()
        known = self.settled()
        if known is not None:
            b, k = batch.alias("b"), known.alias("k")
            batch = b.join(k, (F.col("b.h1") == F.col("k.h1")) & (F.col("b.h2") == F.col("k.h2"))
                           & (F.col("b.doc") < F.col("k.holder")), "left_anti")
        self._write(batch.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("holder")), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(self.entries(merged), level + 1)
            level += 1


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                        min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Every column of ``docs`` in ``row``, with kept_text, n_lines and n_dropped.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses its lines everywhere but in the largest id holding it.
    Lines are kept in order, joined by ``\\n``. Null and empty texts are one
    empty line. Rows that repeat an id count as one document. A null id counts
    as no document and never keeps a repeated line. An empty table gives an
    empty table. Documents are split by a hash of their id into ``batches``.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    lines = stored(hashed_lines(docs, id_col, text_col, min_chars).withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(spark, min_docs, fanout)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    # a table of its own, so that both sides of the join are dealt by it and a line of many documents can be split
    known = stored(runs.settled().select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "holder"), "settled")
    gone = lines.join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    gone = gone.where(~F.col("doc").eqNullSafe(F.col("holder")))
    gone = gone.groupBy("doc", "version").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc").alias("gone_doc"), F.col("version").alias("gone_version"), "gone")
    rows = whole_rows(docs)
    doc, text = F.col(f"row.`{id_col}`").cast("long"), F.col(f"row.`{text_col}`")
    joined = rows.join(gone, doc.eqNullSafe(F.col("gone_doc")) & (F.xxhash64(text) == F.col("gone_version")), "left")
    split = joined.select("row", "gone", text_lines(text).alias("lines"))
    at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(at, lambda i: F.get("lines", i)), "\n"))
    return split.select("row", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"),
                        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
