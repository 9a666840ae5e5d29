"""Readers and sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """In as many parts as the session asks for with ``maskwright.scan.partitions``, else as scanned.

    For sessions that read files too few to split, such as a bench on one
    machine. Nothing here depends on the size of the input.
    """
    parts = df.sparkSession.conf.get("maskwright.scan.partitions", None)
    return df.repartition(int(parts)) if parts else df


def dealt(df: DataFrame) -> DataFrame:
    """Short rows that cost far more to scan than to read, in as many parts as a shuffle of the session has.

    A split of such a file holds millions of rows and would keep one core busy long after the others are done.
    """
    conf = df.sparkSession.conf
    return df if conf.get("maskwright.scan.partitions", None) else df.repartition(int(conf.get("spark.sql.shuffle.partitions")))


def texts(df: DataFrame, key: Column | str, text: Column | str = "text",
          country: Column | None = None) -> DataFrame:
    """Any text column as text units ``(id, text, country)``."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.col(text) if isinstance(text, str) else text
    country = F.lit(None).cast("string") if country is None else country
    return df.select(key.alias("id"), text.alias("text"), country.alias("country"))


def documents(spark, sf_dir) -> DataFrame:
    return texts(read(spark, sf_dir, "documents"), "doc_id")


def conversations(spark, sf_dir) -> DataFrame:
    return texts(read(spark, sf_dir, "conversations"), F.col("conv_id") * 100000 + F.col("turn"))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder below the shared checkpoint folder of the session.

    A local session without that setting gets a folder of its own; a cluster
    must name one that every executor can reach.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", "")
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(base, name)


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For results that several branches of a plan read and that cost more to make
    than to store. The copy is a table, so it outlives lost executors. Branches
    that want some values of the columns ``by`` read only the files of these.
    """
    path = scratch(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_findings(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per detector, so that audits of one kind read only that kind."""
    findings.write.mode(mode).partitionBy("detector").parquet(path)


def write_masked(masked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    masked.write.mode(mode).parquet(path)

