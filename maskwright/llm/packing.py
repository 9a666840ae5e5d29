"""Best-fit packing of texts into sequences of fixed length, under conflicts.

Bins stand in order of the room they have left and carry two bitmaps: sources
and duplicate clusters they hold. A piece goes to the bin with the least room
that fits it and shares neither; the search moves on to the next bin until one
is compatible, else a bin is opened. Shards of bounded size are packed apart.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, ascii_lower, ship

PLACED = "key long, piece int, start long, length long, bin_id long, bin_offset long"


def best_fit(lengths: list[int], sources: list[int | None], clusters: list[int | None], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every piece, placed in the given order; numbers of sources and clusters are bit positions."""
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters):
        s = 0 if source is None else 1 << source
        c = 0 if cluster is None else 1 << cluster
        at = bisect_left(room, (length, -1))
        while at < len(room) and (held_sources[room[at][1]] & s or held_clusters[room[at][1]] & c):
            at += 1
        if at < len(room):
            left, chosen = room.pop(at)
        else:
            left, chosen = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[chosen] |= s
        held_clusters[chosen] |= c
        out.append((chosen, capacity - left))
        if left > length:
            insort(room, (left - length, chosen))
    return out


def _numbered(values: list) -> list[int | None]:
    known: dict = {}
    return [None if v is None else known.setdefault(v, len(known)) for v in values]


def fingerprint(text: Column) -> Column:
    """Equal for texts of the same words, A-Z lower-cased."""
    return F.xxhash64(ascii_lower(F.regexp_replace(F.trim(text), BLANKS + "+", " ")))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         cluster: Column | None = None, length: Column | None = None, capacity: int = 8192, shard_rows: int = 4096) -> DataFrame:
    """(key, piece, start, length, bin_id, bin_offset): where every piece of every row lies.

    ``length`` is by default the text's UTF-8 bytes; a text longer than
    ``capacity`` is cut into full pieces, each a bin of its own, and a rest.
    Pieces are placed longest first, ties by id. No bin holds two pieces of one
    source or of one ``cluster`` (by default texts of the same words); a null
    source or cluster conflicts with nothing. A null or empty text is a row of
    piece 0 and length 0 in no bin. Rows that repeat an id are packed each.
    Shards are drawn by a hash of the row, about ``shard_rows`` rows each, so
    one source may hold any share of the rows.
    """
    text = F.col(text_col)
    size = F.octet_length(text).cast("long") if length is None else length.cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(source_col).alias("source"),
                       F.when(text.isNotNull(), fingerprint(text) if cluster is None else cluster).alias("cluster"),
                       F.coalesce(size, F.lit(0)).alias("length"), F.monotonically_increasing_id().alias("row"))
    shards = max(1, -(-docs.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).drop("row")

    def place(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("key", "ascending")])
        keys, lengths, sources, clusters = (shard[c].to_pylist() for c in ("key", "length", "source", "cluster"))
        base = (shard["shard"][0].as_py() + 1) << 32
        rests = [(n % capacity, i) for i, n in enumerate(lengths) if n % capacity]
        rests.sort(key=lambda x: (-x[0], x[1]))
        placed = best_fit([n for n, _ in rests], _numbered([sources[i] for _, i in rests]),
                          _numbered([clusters[i] for _, i in rests]), capacity)
        next_bin = 1 + max((b for b, _ in placed), default=-1)
        out = [(keys[i], lengths[i] // capacity, lengths[i] - n, n, base + b, at) for (n, i), (b, at) in zip(rests, placed)]
        for key, n in zip(keys, lengths):
            for piece in range(n // capacity):
                out.append((key, piece, piece * capacity, capacity, base + next_bin, 0))
                next_bin += 1
            if n == 0:
                out.append((key, 0, 0, 0, None, None))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in PLACED.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    ship(docs.sparkSession)
    return rows.groupBy("shard").applyInArrow(place, PLACED)
