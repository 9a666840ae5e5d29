"""Regex matches with code-point positions, and slices of long texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import empty, let, scan_fold

HIT = "struct<start:int,end:int,text:string>"
CHUNK = 256


def find_all(text: Column, java_pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern), F.lit(group))


# A private-use character stands for a match while the text around matches is cut out.
MARK = "\ue000"


def gaps(text: Column, java_pattern: str) -> Column:
    """The text between matches, one piece more than there are matches.

    Replacing keeps the compiled pattern, which splitting by a regex does not,
    and splitting by one plain character needs none. A text that already holds
    that character is split by the pattern itself.
    """
    marked = F.split(F.regexp_replace(text, java_pattern, MARK), MARK, -1)
    return F.when(text.contains(MARK), F.split(text, java_pattern, -1)).otherwise(marked)


def placed_once(text: Column, hits: Column) -> Column:
    """Is there one match, and its text at one place only? That place is then the match."""
    hit = F.get(hits, F.lit(0))
    at = F.position(hit, text)
    return (F.size(hits) == 1) & (at > 0) & (F.position(hit, text, at + 1) == 0)


def place(hits: Column, pieces: Column, text: Column) -> Column:
    """Positions of ``hits`` from the text pieces around them, null where :func:`placed_once` holds.

    ``pieces`` is the text split at the same pattern, so match *i* starts after
    pieces ``0..i`` and matches ``0..i-1``.
    """
    def placed(pos: Column, hit: Column) -> Column:
        return F.struct(pos.alias("start"), (pos + F.length(hit)).alias("end"), hit.alias("text"))

    only = F.get(hits, F.lit(0))
    once = F.array(placed(F.position(only, text) - 1, only).cast(HIT))
    return F.when(pieces.isNull(), once).otherwise(scan_fold(
        F.transform(hits, lambda h, i: F.struct(h.alias("hit"), F.get(pieces, i).alias("gap"))),
        F.lit(0),
        lambda pos, x: pos + F.length(x["gap"]) + F.length(x["hit"]),
        lambda pos, x: placed(pos + F.length(x["gap"]), x["hit"]),
        HIT, brief=True))


def hits(text: Column, java_pattern: str) -> Column:
    """All matches as ``array<struct<start,end,text>>`` (0-based, end exclusive)."""
    return let(find_all(text, java_pattern), lambda found: F.when(
        F.size(found) > 0,
        let(F.when(~placed_once(text, found), gaps(text, java_pattern)), lambda pieces: place(found, pieces, text)),
    ).otherwise(empty(HIT)))


def chunked(text: Column) -> Column:
    """The text cut into fixed pieces, so that a slice need not walk from its start."""
    return find_all(text, f"(?s).{{1,{CHUNK}}}")


def slice_of(chunks: Column, lo: Column, hi: Column) -> Column:
    """Code points ``[lo, hi)`` of a chunked text; bounds outside it are clipped."""
    low = F.greatest(lo, F.lit(0))
    high = F.greatest(hi, low)
    first = F.floor(low / CHUNK).cast("int")
    last = F.floor(high / CHUNK).cast("int")
    joined = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.substring(joined, low - first * CHUNK + 1, high - low)
