"""Nearest vectors by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
turns a unit vector; its hash is the nearest signed axis. The index keeps the
hashes of many rotations with every vector. Queries go to the index in blocks
of bounded size: each index batch looks its rows up in the buckets of a query's
nearest axes, ranks the candidates exactly and passes on only the best. Queries
that find too few are compared with every vector of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, stored


FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Tables:
    """``count`` rotations, ``probes`` axes looked up per rotation; more of either raises recall and work."""

    count: int = 16
    probes: int = 6
    seed: int = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def rotations(x: np.ndarray, tables: Tables) -> Iterator[np.ndarray]:
    """The rows of ``x`` under each pseudo-rotation, zero-padded to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), width), np.float32)
    padded[:, :x.shape[1]] = x
    rng = np.random.default_rng([tables.seed, width])
    signs = rng.integers(0, 2, (tables.count, 3, width)).astype(np.float32) * 2 - 1
    for t in range(tables.count):
        turned = padded
        for k in range(3):
            turned = hadamard(turned * signs[t, k]) / np.float32(np.sqrt(width))
        yield turned


def nearest_axis(turned: np.ndarray) -> np.ndarray:
    """2 * axis + (1 for its negative side)."""
    axis = np.argmax(np.abs(turned), axis=1)
    return 2 * axis + (turned[np.arange(len(turned)), axis] < 0)


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, ids, matrix) for each width; rows that take no part are left out."""
    if pa.types.is_list(vectors.type) or pa.types.is_large_list(vectors.type):
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    else:
        raise TypeError(f"vectors of type {vectors.type}")
    at = np.concatenate([[0], np.cumsum(lengths)])
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for width in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == width) & known)
        made = flat[at[rows][:, None] + np.arange(width)]
        good = np.isfinite(made).all(axis=1)
        good[good] = np.abs(made[good]).max(axis=1) > 0
        if good.any():
            yield rows[good], numbers[rows[good]], made[good]


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and the lengths they had; scaled first, so that no square overflows."""
    most = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / most
    norm = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
    return scaled / norm[:, None], norm * most[:, 0]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, the largest component from 1/2 to 1: cosines stay as they are, and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def build_index(vectors: DataFrame, id_col: str, vector_col: str, tables: Tables) -> DataFrame:
    """(id, vector, hashes) of every vector that takes part, as a table in the shared folder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, x in matrices(batch.column(0), batch.column(1)):
                codes = np.stack([nearest_axis(t) for t in rotations(unit(x)[0], tables)], axis=1).astype(np.int32)
                width = x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * width, pa.array(x.ravel())),
                     pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * tables.count, pa.array(codes.ravel()))],
                    ["id", "vector", "hashes"])

    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return stored(arrow_map(picked, rows, "id long, vector array<double>, hashes array<int>"), "vector-index")


def _probes(x: np.ndarray, tables: Tables) -> np.ndarray:
    """[query, rotation, probe]: the nearest signed axes of every query."""
    out = []
    for turned in rotations(unit(x)[0], tables):
        axes = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :tables.probes]
        out.append(2 * axes + (np.take_along_axis(turned, axes, 1) < 0))
    return np.stack(out, axis=1)


def _best(query_ids, queries, probes, ids, x, codes, k: int):
    """The best ``k`` ids of this batch for every query, from all rows without ``probes``: (query id, id, score)."""
    by_id = np.argsort(ids, kind="stable")
    ids, x, codes = ids[by_id], x[by_id], codes[by_id]
    n, count = len(ids), codes.shape[1]
    if probes is not None:
        order = np.argsort(codes, axis=0, kind="stable")
        sides = int(codes.max()) + 2
        starts = np.stack([np.searchsorted(codes[order[:, t], t], np.arange(sides)) for t in range(count)])
    x, queries = scaled(x), scaled(queries)
    norms, q_norms = (np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (x, queries))
    found = ([], [], [])
    for q in range(len(query_ids)):
        hit = np.full(n, probes is None)
        for t in range(count if probes is not None else 0):
            row, at = order[:, t], starts[t]
            for side in probes[q, t]:
                if side + 1 < sides:
                    hit[row[at[side]:at[side + 1]]] = True
        hit &= ids != query_ids[q]
        rows = np.flatnonzero(hit)
        if len(rows) == 0:
            continue
        score = np.einsum("ij,j->i", x[rows], queries[q]) / (norms[rows] * q_norms[q])
        # rows of one id lie together: the best of each, before the cut to ``k``
        own = ids[rows]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        own, score = own[first], np.maximum.reduceat(score, first)
        if len(own) > k:  # all that tie with the k-th stay in
            kept = score >= np.partition(score, len(score) - k)[len(score) - k]
            own, score = own[kept], score[kept]
        best = np.lexsort((own, -score))[:k]
        for column, values in zip(found, (np.full(len(best), query_ids[q]), own[best], score[best])):
            column.extend(values.tolist())
    return found


def search(index: DataFrame, asked: DataFrame, k: int, tables: Tables, block: int, exact: bool = False) -> DataFrame:
    """(query_id, vec_id, score): the best ``k`` of every index batch for each query (id, vector), from its buckets or from all rows."""
    spark = index.sparkSession
    blocks = -(-asked.count() // block)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))).cast("int"))
    asked = stored(asked, "vector-blocks", "block") if blocks > 1 else asked
    found = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        held = asked.where(F.col("block") == b).select("id", "vector").toArrow().combine_chunks()
        columns = [held.column(i).combine_chunks() if held.num_rows else pa.array([], held.schema.field(i).type) for i in (0, 1)]
        by_width = {x.shape[1]: (ids, x, None if exact else _probes(x, tables)) for _, ids, x in matrices(*columns)}
        if not by_width:
            continue
        spread = spark.sparkContext.broadcast(by_width)

        def rows(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, tables.count)
                for at, ids, x in matrices(batch.column(0), batch.column(1)):
                    if x.shape[1] in spread.value:
                        q, i, s = _best(*spread.value[x.shape[1]], ids, x, codes[at], k)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())],
                                                         ["query_id", "vec_id", "score"])

        found = found.unionByName(stored(arrow_map(index, rows, FOUND), "vector-found"))
        spread.unpersist()
    return found


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            tables: Tables = Tables(), block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query by cosine, ties to the smaller id.

    Vectors that are null, zero, empty, or hold null or non-finite components
    take no part, nor do rows without an id; vectors of different lengths are
    not compared. Candidates are all rows but those with the query's id; rows
    that repeat an id count once, with their best score. Equal vectors share
    all hashes, so none of them is lost. Queries are searched in blocks of
    about ``block``, each a pass over the index; those with fewer than ``k``
    found are searched once more among all vectors, so that they have fewer
    only where there are no more.
    """
    index = build_index(vectors, id_col, vector_col, tables)
    picked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = stored(picked, "vector-queries")
    found = search(index, asked, k, tables, block)
    full = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = stored(asked.join(full, F.col("id") == F.col("query_id"), "left_anti"), "vector-short")
    found = found.unionByName(search(index, short, k, tables, block, exact=True))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
