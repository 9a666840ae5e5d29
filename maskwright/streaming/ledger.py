"""Tables that a stream writes batch by batch, each batch once.

``data`` holds the rows below ``<by>=.../batch=<id>``, ``ledger`` one small
file for every batch that is complete. A batch counts from the moment its file
is in the ledger: what a killed batch left behind is not read and replaced
when the batch is repeated; a repeated batch that is in the ledger is left out.

A replay log keeps versions of keys in buckets of such a table. Readers put the
newest base of a bucket and the batches after it together; compaction writes a
new base for buckets with enough batches and touches no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import newest

BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def _enter(counts: DataFrame, path: str) -> None:
    """One file, which appears as a whole."""
    counts.coalesce(1).write.mode("overwrite").parquet(path)


def put(batch: DataFrame, batch_id: int, path: str, by: str) -> None:
    """Write a batch below ``path``, unless the ledger has it. Empty batches are entered too."""
    spark = batch.sparkSession
    entry = f"{path}/ledger/batch={batch_id}"
    if _exists(spark, f"{entry}/_SUCCESS"):
        return
    batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch").parquet(f"{path}/data")
    kind = batch.schema[by].dataType.simpleString()
    written = f"{path}/data/*/batch={batch_id}"  # no other batch is listed
    if _exists(spark, written):
        parts = spark.read.schema(f"{batch.schema.toDDL()}, batch bigint").option("basePath", f"{path}/data").parquet(written)
        counts = parts.groupBy(F.col(by).cast(kind).alias("part")).agg(F.count("*").alias("n"))
    else:
        counts = spark.createDataFrame([], f"part {kind}, n bigint")
    _enter(counts, entry)


def entries(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """(part, n, batch) of all complete batches; a batch without rows has none."""
    schema = f"part {kind}, n bigint, batch bigint"
    if not _exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/ledger")


def rows(spark: SparkSession, path: str, schema, by: str) -> DataFrame:
    """Rows of complete batches, with the number of their batch. ``schema`` is that of the batches."""
    kind = schema[by].dataType.simpleString()
    found = entries(spark, path, kind)
    if not _exists(spark, f"{path}/data"):
        return spark.createDataFrame([], f"{schema.toDDL()}, batch bigint")
    done = found.select("batch").distinct()
    data = spark.read.schema(f"{schema.toDDL()}, batch bigint").parquet(f"{path}/data").withColumn(by, F.col(by).cast(kind))
    return data.join(done, "batch", "left_semi").select(*schema.names, "batch")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, by: str) -> None:
    """Process everything available, each batch once below ``path``, and stop."""
    stream.writeStream.foreachBatch(lambda batch, number: put(batch, number, path, by)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def log_changes(changes: DataFrame, path: str, checkpoint: str, keys: list[str], version: str,
                buckets: int = BUCKETS) -> None:
    """Process all changes available: a batch adds the newest version of each of its keys, without state."""
    def add(batch: DataFrame, number: int) -> None:
        latest = newest(batch, keys, version).select(*batch.columns)
        put(latest.withColumn("bucket", bucket_of(keys, buckets)), number, f"{path}/delta", "bucket")
    changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start().awaitTermination()


def _parts(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """Newest base of every bucket, and batches after it; a base is numbered by the last batch that it holds."""
    full = schema.add("bucket", "integer") if "bucket" not in schema.names else schema
    bases = entries(spark, f"{path}/base", "int").groupBy("part").agg(F.max("batch").alias("upto")).withColumnRenamed(
        "part", "bucket")
    base = rows(spark, f"{path}/base", full, "bucket").withColumnRenamed("batch", "upto").join(bases, ["bucket", "upto"], "left_semi")
    delta = rows(spark, f"{path}/delta", full, "bucket").join(bases, "bucket", "left").where(
        F.col("upto").isNull() | (F.col("batch") > F.col("upto"))).drop("upto")
    return base, delta


def current(spark: SparkSession, path: str, schema, keys: list[str], version: str) -> DataFrame:
    """The newest version of every key of the log. ``schema`` is that of the changes."""
    base, delta = _parts(spark, path, _copy(schema))
    both = base.select(*schema.names).unionByName(delta.select(*schema.names))
    return newest(both, keys, version).select(*schema.names)


def compact(spark: SparkSession, path: str, schema, keys: list[str], version: str, batches: int = 8) -> int:
    """A new base for the buckets that at least ``batches`` batches were added to; returns their number.

    The log stays readable meanwhile: readers see the old parts or the new base.
    To be run between batches, not beside them, and numbered by the last batch,
    so that a repeated compaction does nothing.
    """
    base, delta = _parts(spark, path, _copy(schema))
    last = entries(spark, f"{path}/delta", "int").agg(F.max("batch")).first()[0]
    due = delta.select("bucket", "batch").distinct().groupBy("bucket").count().where(F.col("count") >= batches).select("bucket")
    n = 0 if last is None or _exists(spark, f"{path}/base/ledger/batch={last}/_SUCCESS") else due.count()
    if n:
        names = [*schema.names, "bucket"]
        both = base.select(*names).unionByName(delta.select(*names)).join(due, "bucket", "left_semi")
        put(newest(both, keys, version).select(*names), last, f"{path}/base", "bucket")
    return n


def _copy(schema):
    return type(schema)(list(schema.fields))
