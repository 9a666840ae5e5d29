"""Ranked lexical search by pipelined term partitioning.

Documents are indexed where they are read: a task cuts its documents into
shards and writes, for every term that some item has, the positions and counts
of the shard's documents. Terms belong to owners, the rarest to the first.
Items travel in bundles, one for every shard, which carry the sparse scores of
the shard's documents: at each owner a cogroup by (shard, bundle) brings the
owner's postings, whose integer contributions are added, and the bundle goes on
to the next. The best of every shard are ranked at the end.

Between two owners the scores of all shards give each item a lower bound of
its last rank. A document whose score and whose share of all terms still to
come stay below that bound cannot reach a rank and is left out of the bundle;
this is exact. Nothing else is left out: no term, document or item.

Terms are the maximal runs of ASCII letters and digits and of all characters
beyond ASCII, A-Z lower-cased; they meet by 64-bit hashes. Nulls: a null text
has no terms; null ids rank last among equal scores. Rows that repeat a
document's id are documents of their own; item rows that repeat id and text are
one item, those that share an id only are ranked apart. Texts longer than a
piece are cut between terms and counted piece by piece. Ties go to the smaller
document id. An empty table on either side gives an empty result. Other columns
are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, stored
from .words import U64, mix, pieces, utf8, word_hashes, word_spans

#: Bytes of text that are turned into arrays at once.
PIECE = 1 << 20
#: A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 21
#: Items are searched so many at a time, in bundles; an owner has about so many pairs of term and item.
BATCH_ITEMS, BUNDLE_ITEMS, OWNER_PAIRS = 1 << 16, 128, 1 << 20
#: The first owners have the terms that at most one of so many documents holds, the last all others.
OWNER_SHARES = (64, 16, 4)
#: Bits of the map of all items' terms (2 MB).
MAP_BITS = 24
#: No contribution of a term is larger than its weight times this.
MOST = 1_000_000

#: Bytes as parts of terms: A-Z as a-z, what is in no term as a blank.
TERM_BYTE = np.full(256, 32, np.uint8)
TERM_BYTE[48:58], TERM_BYTE[97:123], TERM_BYTE[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
TERM_BYTE[65:91] = np.arange(97, 123)

INDEX = "shard long, ids array<long>, lengths array<long>, terms array<long>, docs array<int>, pos array<int>, tf array<int>"
BUNDLE = "shard long, bundle int, ids array<long>, items array<int>, pos array<int>, scores array<long>, top_items array<int>, top_scores array<long>"


def term_pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(hash of every term, its text, whether these texts are complete), piece by piece."""
    data, offsets = utf8(column)
    data = TERM_BYTE[data]
    for a, b in pieces(offsets, PIECE):
        low, high = int(offsets[a]), int(offsets[b])
        while low < high:
            end = high if high - low <= PIECE else _blank(data, low + PIECE, high)
            starts, ends, first = word_spans(data[low:end], np.clip(offsets[a:b + 1], low, end) - low)
            yield word_hashes(data[low:end], starts, ends), np.repeat(np.arange(a, b), np.diff(first)), end == high
            low = end


def _blank(data: np.ndarray, at: int, high: int) -> int:
    """The first place from ``at`` on that is in no term."""
    while at < high:
        found = np.flatnonzero(data[at:min(high, at + PIECE)] == 32)
        if len(found):
            return at + int(found[0])
        at += PIECE
    return high


def _bit(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = mix(hashes) >> U64(64 - MAP_BITS)
    return (at >> U64(6)).astype(np.int64), at & U64(63)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term): the distinct terms of every row (item, text)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for hashes, owner, _ in term_pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(keys[owner]), pa.array(hashes.view(np.int64))], ["item", "term"])

    return arrow_map(items.select("item", "text"), make, "item long, term long").distinct()


def term_map(pairs: DataFrame) -> np.ndarray:
    """A map of fixed size with a bit for every term of (item, term)."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = _bit(batch.column(0).to_numpy().view(U64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((U64(1) << bit).view(np.int64))], ["word", "bits"])

    found = arrow_map(pairs.select("term").distinct(), bits, "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), U64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(U64)
    return out


class _Shard:
    """Documents and postings that a task holds until they are a row of the index."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, hashes: np.ndarray, pos: np.ndarray) -> None:
        merged = _counted(hashes, pos, np.ones(len(hashes), np.int64))
        self.parts.append(merged)
        self.held += len(merged[0])

    def row(self, name: int) -> pa.RecordBatch:
        hashes, pos, tf = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        hashes, pos, tf = _counted(hashes, pos, tf)
        terms, docs = np.unique(hashes, return_counts=True)
        lists = [pa.array(self.ids, pa.int64()), pa.array(self.lengths, pa.int64()), pa.array(terms.view(np.int64)),
                 pa.array(docs.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(tf.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([name]), *map(_one_list, lists)],
                                          ["shard", "ids", "lengths", "terms", "docs", "pos", "tf"])


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _counted(hashes: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (hash, position) added up, in order."""
    if len(hashes) == 0:
        return hashes, pos, n
    order = np.lexsort((pos, hashes))
    hashes, pos, n = hashes[order], pos[order], n[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (pos[1:] != pos[:-1])
    at = np.flatnonzero(first)
    return hashes[at], pos[at], np.add.reduceat(n, at)


def build_index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Shards of rows (doc, text) with the postings of all terms that are in the map ``wanted``; texts without a term leave."""
    shown = docs.sparkSession.sparkContext.broadcast(wanted)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column(0)
            place = np.full(len(keys), -1)  # of the batch's texts in the shard
            for hashes, owner, complete in term_pieces(batch.column(1)):
                kinds, n = np.unique(owner, return_counts=True)
                for text, terms in zip(kinds.tolist(), n.tolist()):
                    if place[text] < 0:
                        place[text] = len(shard.ids)
                        shard.ids.append(keys[text].as_py())
                        shard.lengths.append(0)
                    shard.lengths[place[text]] += terms
                word, bit = _bit(hashes)
                kept = (shown.value[word] >> bit) & U64(1) > 0
                shard.add(hashes[kept], place[owner[kept]])
                if complete and (len(shard.ids) >= SHARD_DOCS or shard.held >= SHARD_POSTINGS):
                    yield shard.row(name)
                    shard, name = _Shard(), name + 1
        if shard.ids:
            yield shard.row(name)

    return arrow_map(docs.select("doc", "text"), make, INDEX)


@dataclass
class Bundle:
    """What the tasks need to know of a bundle at one owner: its terms there, and its items' bounds."""

    terms: np.ndarray    # sorted, one per pair of term and item
    weights: np.ndarray
    items: np.ndarray    # place of the item in the bundle
    to_come: np.ndarray  # the most that all later owners can add, per item
    bound: np.ndarray    # what a document must reach, per item


def weighed(pairs: DataFrame, index: DataFrame, documents: int) -> DataFrame:
    """(item, term, w, owner) of the pairs whose term some document holds, without terms of weight 0."""
    held = index.select(F.inline(F.arrays_zip("terms", "docs"))).groupBy(F.col("terms").alias("term")).agg(
        F.sum(F.col("docs").cast("long")).alias("df"))
    df = F.col("df")
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * df + 1))).cast("long")
    owner = F.lit(len(OWNER_SHARES))
    for k in range(len(OWNER_SHARES) - 1, -1, -1):
        owner = F.when(df * OWNER_SHARES[k] <= documents, F.lit(k)).otherwise(owner)
    return pairs.join(held, "term").select("item", "term", weight.alias("w"), owner.alias("owner")).where("w > 0")


def _routed(index: DataFrame, bundles, documents: int, terms: int) -> DataFrame:
    """(shard, bundle, term, count, pos, impact): an owner's postings for every bundle that has its terms."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard = batch.column("shard")[r].as_py()
                lengths, held, docs, pos, tf = (batch.column(c)[r].values.to_numpy() for c in ("lengths", "terms", "docs", "pos", "tf"))
                held = held.view(U64)
                at = np.concatenate([[0], np.cumsum(docs)])
                m = np.array([10 + 90 * n * documents // terms for n in lengths.tolist()], np.int64)
                tf = tf.astype(np.int64)
                impact = (1_000_000_000 * tf // (1000 * tf + 8 * m[pos])).astype(np.int32)
                for name, bundle in bundles.value.items():
                    mine = np.flatnonzero(np.isin(held, bundle.terms))
                    if len(mine) == 0:
                        continue
                    taken = np.repeat(at[mine] - np.concatenate([[0], np.cumsum(docs[mine])[:-1]]), docs[mine]) + np.arange(docs[mine].sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard]), pa.array([name], pa.int32()),
                         *(_one_list(pa.array(x)) for x in (held[mine].view(np.int64), docs[mine], pos[taken], impact[taken]))],
                        ["shard", "bundle", "terms", "docs", "pos", "impact"])

    return arrow_map(index, make, "shard long, bundle int, terms array<long>, docs array<int>, pos array<int>, impact array<int>")


def _owner(bundles, k: int):
    """A cogroup of a bundle at one shard with the owner's postings there: the bundle with their contributions."""
    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        shard, name = left["shard"][0].as_py(), left["bundle"][0].as_py()
        ids, items, pos, scores = (left[c].combine_chunks().flatten() for c in ("ids", "items", "pos", "scores"))
        bundle = bundles.value[name]
        total = np.zeros((len(bundle.to_come), len(ids)), np.int64)
        total[items.to_numpy(), pos.to_numpy()] = scores.to_numpy()
        for r in range(right.num_rows):
            held, docs, at, impact = (right[c][r].values.to_numpy() for c in ("terms", "docs", "pos", "impact"))
            ends = np.cumsum(docs)
            first, last = (np.searchsorted(bundle.terms, held.view(U64), side) for side in ("left", "right"))
            for t in range(len(held)):
                mine = slice(ends[t] - docs[t], ends[t])
                for p in range(first[t], last[t]):
                    total[bundle.items[p], at[mine]] += bundle.weights[p] * impact[mine].astype(np.int64)
        kept = (total > 0) & (total + bundle.to_come[:, None] >= bundle.bound[:, None])
        items, pos = np.nonzero(kept)
        scores = total[items, pos]
        top_items, top_scores = [], []
        for i in range(len(total)):
            row = total[i]
            if len(row) > k:
                row = np.partition(row, len(row) - k)[len(row) - k:]
            row = row[row > 0]
            top_items.append(np.full(len(row), i))
            top_scores.append(row)
        lists = [ids, *(pa.array(x) for x in (items.astype(np.int32), pos.astype(np.int32), scores,
                                              np.concatenate(top_items).astype(np.int32), np.concatenate(top_scores)))]
        return pa.table([pa.array([shard]), pa.array([name], pa.int32()), *map(_one_list, lists)],
                        names=["shard", "bundle", "ids", "items", "pos", "scores", "top_items", "top_scores"])

    return add


def _best(k: int):
    """The rows (bundle, place, doc, score) of each shard's bundle that can be among an item's ``k`` best."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].values
                items, pos, scores = (batch.column(c)[r].values.to_numpy() for c in ("items", "pos", "scores"))
                none = np.asarray(ids.is_null())
                doc = ids.fill_null(0).to_numpy()
                order = np.lexsort((doc[pos], none[pos], -scores, items))
                first = np.searchsorted(items[order], items[order], "left")
                order = order[np.arange(len(order)) - first < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(order), batch.column("bundle")[r].as_py()), pa.int32()), pa.array(items[order]),
                     ids.take(pa.array(pos[order])), pa.array(scores[order])], ["bundle", "place", "doc", "score"])

    return make


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (bundle, place, doc, score) of every item with their rank; tasks pass on no more than that."""
    by = Window.partitionBy("bundle", "place").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _search_batch(index: DataFrame, pairs: DataFrame, items: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """(item, rank, doc, score) for one batch of items, given in order, through all owners."""
    spark = index.sparkSession
    counts = pairs.groupBy("owner").agg(F.count("*").alias("n")).collect()
    stages = sorted((r.owner, part, -(-r.n // OWNER_PAIRS)) for r in counts for part in range(-(-r.n // OWNER_PAIRS)))
    # an owner that is too large for one stage is cut by terms
    mine = [pairs.where((F.col("owner") == o) & (F.pmod(F.xxhash64("term"), F.lit(parts)) == part)) for o, part, parts in stages]
    to_come = np.zeros((len(stages) + 1, len(items)), np.int64)
    for s, rows in enumerate(mine):
        sums = rows.groupBy("item").agg(F.sum("w").alias("w")).toArrow()
        to_come[s, np.searchsorted(items, sums["item"].to_numpy())] = sums["w"].to_numpy() * MOST
    to_come = np.cumsum(to_come[::-1], axis=0)[::-1]
    bound = np.zeros(len(items), np.int64)
    bundles = -(-len(items) // BUNDLE_ITEMS)
    number = F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))
    none = [F.array().cast(f"array<{t}>").alias(c) for c, t in (
        ("items", "int"), ("pos", "int"), ("scores", "long"), ("top_items", "int"), ("top_scores", "long"))]
    now = index.select("shard", number.alias("bundle"), "ids", *none)
    for s, rows in enumerate(mine):
        found = rows.select("item", "term", "w").toArrow()
        at = np.searchsorted(items, found["item"].to_numpy())
        term, weight = found["term"].to_numpy().view(U64), found["w"].to_numpy()
        order = np.lexsort((at, term))
        at, term, weight = at[order], term[order], weight[order]
        shown = {}
        for b in range(bundles):
            own = slice(b * BUNDLE_ITEMS, min(len(items), (b + 1) * BUNDLE_ITEMS))
            held = np.flatnonzero(at // BUNDLE_ITEMS == b)
            shown[b] = Bundle(term[held], weight[held], at[held] % BUNDLE_ITEMS, to_come[s + 1][own], bound[own])
        shown = spark.sparkContext.broadcast(shown)
        postings = _routed(index, shown, documents, terms)
        now = stored(now.groupBy("shard", "bundle").cogroup(postings.groupBy("shard", "bundle")).applyInArrow(_owner(shown, k), BUNDLE),
                     f"owner-{s}")
        if s + 1 < len(stages):
            tops = now.select("bundle", F.inline(F.arrays_zip("top_items", "top_scores"))).select(
                "bundle", F.col("top_items").alias("place"), F.lit(None).cast("long").alias("doc"), F.col("top_scores").alias("score"))
            least = _ranked(tops, k).where(F.col("rank") == k).select("bundle", "place", "score").toArrow()
            bound[least["bundle"].to_numpy() * BUNDLE_ITEMS + least["place"].to_numpy()] = least["score"].to_numpy()
    best = _ranked(arrow_map(now.select("bundle", "ids", "items", "pos", "scores"), _best(k), "bundle int, place int, doc long, score long"), k)
    best = stored(best, "ranked")
    names = spark.createDataFrame(pa.table([pa.array(np.arange(len(items))), pa.array(items)], names=["number", "item"]))
    number = F.col("bundle").cast("long") * BUNDLE_ITEMS + F.col("place")
    return best.withColumn("number", number).join(names, "number").select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """(item, rank, doc, score): the ``k`` documents of the highest positive scores for every item.

    With N documents that have a term, L terms in all, n in a document, df
    documents that hold a term and tf occurrences in a document, a term's weight
    is ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``, a document's m is
    ``10 + 90 * n * N div L``, and its score sums weight times
    ``1000000000 * tf div (1000 * tf + 8 * m)`` over the item's different terms.
    """
    spark = docs.sparkSession
    asked = stored(items.select(F.col(item_col).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates()
                   .withColumn("item", F.monotonically_increasing_id()), "items")
    pairs = stored(item_terms(asked), "item-terms")
    index = stored(build_index(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), term_map(pairs)), "index")
    sums = index.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    known = stored(weighed(pairs, index, sums.n or 0), "weights")
    batches = -(-known.select("item").distinct().count() // BATCH_ITEMS)
    out = None
    for b in range(batches):
        mine = known.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == b)
        numbers = np.sort(mine.select("item").distinct().toArrow()["item"].to_numpy())
        if len(numbers):
            found = _search_batch(index, mine, numbers, sums.n, sums.l, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.limit(0).select(F.col("name").alias("item"), F.lit(1).alias("rank"), F.lit(1).cast("long").alias("doc"),
                                     F.lit(1).cast("long").alias("score"))
    return out.join(asked.select("item", "name"), "item").select(F.col("name").alias("item"), "rank", "doc", "score")
