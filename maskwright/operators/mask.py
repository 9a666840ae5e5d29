"""Masking, annotation and their inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions.arrays import let
from ..functions.matching import chunked, slice_of
from ..functions.windows import running_sum

NODES_PER_BUCKET = 1024
STRETCH = 4096
SPAN_ATTRIBUTE = "data-pii"
STAR, BLOCK, DISC = "*", "█", "●"
_SPAN = rf'<span {SPAN_ATTRIBUTE}="[a-z]+">((?s:.*?))</span>'


def rebuild(text: Column, matches: Column, render) -> Column:
    """The text with every match replaced by ``render(match)``."""
    def build(chunks: Column) -> Column:
        def piece(m: Column, i: Column) -> Column:
            last = F.when(i > 0, F.get(matches, i - 1)["end"]).otherwise(0)
            return F.concat(slice_of(chunks, last, m["start"]), render(m))
        tail = slice_of(chunks, F.element_at(matches, -1)["end"], F.length(text))
        return F.concat(F.array_join(F.transform(matches, piece), ""), tail)
    return F.when(F.size(matches) > 0, let(chunked(text), build)).otherwise(text)


def _fill(glyph: str):
    return lambda m: F.repeat(F.lit(glyph), m["end"] - m["start"])


def mask_starred(text: Column, matches: Column) -> Column:
    return rebuild(text, matches, _fill(STAR))


def mask_redacted(text: Column, matches: Column) -> Column:
    return rebuild(text, matches, _fill(BLOCK))


def mask_censored(text: Column, matches: Column) -> Column:
    return rebuild(text, matches, _fill(DISC))


def mask_by_mode(text: Column, matches: Column, mode: Column) -> Column:
    """Starred, redacted or censored as ``mode`` says; other modes only annotate."""
    glyph = (F.when(mode == "starred", STAR).when(mode == "redacted", BLOCK)
             .when(mode == "censored", DISC))
    return F.when(glyph.isNull(), annotate(text, matches)).otherwise(
        rebuild(text, matches, lambda m: F.repeat(F.coalesce(glyph, F.lit(STAR)),
                                                  m["end"] - m["start"])))


def annotate(text: Column, matches: Column) -> Column:
    """Wrap every match in a span that names its type."""
    return rebuild(text, matches, lambda m: F.concat(
        F.lit(f'<span {SPAN_ATTRIBUTE}="'), m["type"], F.lit('">'), m["text"], F.lit("</span>")))


def unmask(annotated: Column) -> Column:
    """Remove the spans again."""
    return F.regexp_replace(annotated, _SPAN, "$1")


def unmasked_parts(annotated: Column) -> Column:
    """The text outside existing spans, in order: what a rescan may look at."""
    return F.split(annotated, _SPAN, -1)


def mask_range(nodes: DataFrame, ranges: DataFrame, glyph: str = STAR) -> DataFrame:
    """Mask caller-given ranges over the nodes of a page.

    ``nodes(page_id, node_id, text)`` lie one after another by ``node_id``;
    ``ranges(page_id, range_id, start, end)`` count characters over the whole
    page. Each range is clipped to every node it touches.
    """
    sized = nodes.withColumn("len", F.length("text"))
    placed = running_sum(sized, ["page_id"], F.floor(F.col("node_id") / NODES_PER_BUCKET), ["node_id"],
                         F.col("len"), "upto").withColumn("at", F.col("upto") - F.col("len"))
    # Nodes and ranges meet per stretch of the page they both touch; a pair that shares several
    # stretches is taken in the first of them, so it appears once and far pairs never meet.
    def stretches(df: DataFrame, lo: Column, hi: Column, name: str) -> DataFrame:
        first = F.floor(lo / STRETCH)
        last = F.floor(F.greatest(hi - 1, lo) / STRETCH)
        return df.withColumn(name, first).withColumn("stretch", F.explode(F.sequence(first, last)))

    left = stretches(placed, F.col("at"), F.col("upto"), "_node_first")
    right = stretches(ranges, F.col("start"), F.col("end"), "_range_first")
    clipped = left.join(right, ["page_id", "stretch"]).where(
        (F.col("stretch") == F.greatest("_node_first", "_range_first"))
        & (F.col("start") < F.col("upto")) & (F.col("end") > F.col("at"))).select(
        "page_id", "node_id", "range_id", "text",
        F.greatest(F.col("start") - F.col("at"), F.lit(0)).cast("int").alias("lo"),
        F.least(F.col("end") - F.col("at"), F.col("len")).cast("int").alias("hi"))
    return clipped.where(F.col("lo") < F.col("hi")).select(
        "page_id", "node_id", "range_id", "lo", "hi",
        F.concat(F.substring("text", F.lit(1), F.col("lo")),
                 F.repeat(F.lit(glyph), F.col("hi") - F.col("lo")),
                 F.substring("text", F.col("hi") + 1, F.length("text"))).alias("masked"))


def remove_ranges(ranges: DataFrame, removed: DataFrame) -> DataFrame:
    """Ranges that stay after the given range ids were lifted."""
    return ranges.join(removed.select("page_id", "range_id"), ["page_id", "range_id"], "left_anti")


_ICON_LINK = (r"""(?i)(<link\b(?=[^>]*\brel\s*=\s*["']?[^"'>]*icon)[^>]*\bhref\s*=\s*)"""
              r"""("[^"]*"|'[^']*'|[^\s"'>]+)""")


def title_redact(html: Column) -> Column:
    """Fixed page title and blank icon; an icon link is added where there is none."""
    titled = F.regexp_replace(html, r"(?is)(<title\b[^>]*>).*?(</title\s*>)",
                              f"$1{V.REPLACEMENT_TITLE}$2")
    blank = F.regexp_replace(titled, _ICON_LINK, f'$1"{V.BLANK_ICON}"')
    added = F.regexp_replace(titled, r"(?i)</head\s*>",
                             f'<link rel="icon" href="{V.BLANK_ICON}"></head>')
    return F.when(html.rlike(_ICON_LINK), blank).otherwise(added)
