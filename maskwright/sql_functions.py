"""``pii_scan`` and ``pii_mask`` as functions of a session's SQL.

Both are SQL functions whose bodies are the text of the same column
expressions that the DataFrame operators build, so a query that calls them has
the plan it would have there: no Python, no shuffle, one pass over each text.

    SELECT doc_id, f.* FROM (SELECT doc_id, pii_scan(text) AS m FROM documents) LATERAL VIEW inline(m) f
    SELECT doc_id, pii_mask(text, 'starred') AS text FROM documents

Spark takes no SQL function inside a generator, hence the inner select.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions.arrays import let
from .operators import detect, mask, resolve

#: In the text of a column: string literals, which stay, and operators written as functions, which need quotes to be read again.
_PARTS = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`.])(and|or|in|[!%*+\-/<>=]+)\(", re.S)


def sql_text(column: Column) -> str:
    """The column expression as SQL that parses to the same expression."""
    shown = str(column)[len("Column<'"):-len("'>")]
    return _PARTS.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], shown)


def statements(email: bool = True, numeric: bool = True, profile: str = "precise") -> list[str]:
    """The statements that define both functions over the detectors registered now."""
    text, mode = F.col("text"), F.col("mode")
    found = resolve.scan("text", "country", email, numeric, profile)
    masked = F.when(text.isNotNull(), let(found, lambda m: mask.mask_by_mode(text, m, mode)))
    args = "text STRING, {}country STRING DEFAULT NULL"
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION pii_scan({args.format('')}) RETURNS ARRAY<{resolve.MATCH}> RETURN {sql_text(found)}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION pii_mask({args.format('mode STRING, ')}) RETURNS STRING RETURN {sql_text(masked)}",
    ]


def register(spark: SparkSession, **options) -> None:
    """Define ``pii_scan(text[, country])`` and ``pii_mask(text, mode[, country])`` in the session.

    ``pii_scan`` gives the findings in order, ``array<struct<start,end,type,detector,text>>``.
    ``mode`` is starred, redacted or censored; others annotate. A null text has
    no findings and stays null. Detectors that are registered later need another
    call, as the bodies are those of the catalogue at the time.
    """
    key = (tuple(detect.catalogue()), tuple(sorted(options.items())))
    if getattr(spark, "_maskwright_functions", None) == key:
        return
    for statement in statements(**options):
        spark.sql(statement)
    spark._maskwright_functions = key
