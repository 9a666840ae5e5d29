"""Scanning new and changed texts as a stream.

The scan is one stateless expression, so the batch expression runs on a stream
as it is. State appears only where versions of a node must be told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve

WATERMARK = "1 hour"


def source(spark: SparkSession, sf_dir: str, table: str, per_trigger: int = 16) -> DataFrame:
    """A table, one file or a folder of files, as a stream of files."""
    path = f"{sf_dir}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def scan_stream(units: DataFrame) -> DataFrame:
    """Findings of a stream of ``(id, text, country)``; same expressions as the batch scan."""
    return resolve.with_matches(units).select("id", F.inline("m")).select(
        "id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "type", "detector",
        F.col("text").alias("hit"))


def text_changes(changes: DataFrame) -> DataFrame:
    """Only added and edited texts are scanned; attribute changes and the like are not.

    ``changes(page_id, node_id, op, text, ts)``. A change delivered twice within
    the watermark is dropped.
    """
    return changes.where(F.col("op").isin("childList", "characterData")) \
        .withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["page_id", "node_id", "op", "text"])


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available, append to ``path`` and stop."""
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def newest(changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest version of each node; on a stream the state is one row per node that changed."""
    rest = [x for x in changes.columns if x not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("n")).select(*keys, "n.*")


def run_to_end_whole(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available; ``path`` holds the whole result after every batch."""
    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start().awaitTermination()


def replay(backfill: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """First scan plus the changes that arrived during it: newest version of each node, once.

    Both sides carry ``version``; versions of a node are compared, never collected.
    """
    return newest(backfill.unionByName(changes.select(*backfill.columns)), keys, version)
