"""Exact similarity join of word-shingle sets, up to connected components.

Equal sets are one class, of which one document stands for all. Links between
different sets are found in two ways that together miss none:

* Sets with one of six sketches in common (the two smallest and the two largest
  of three hashes of their shingles) meet in a block and are compared through
  the block's index, a probe at a time in order of size. The
  lists of the index are skipped to the positions whose sizes can match, and a
  set much like the one before it takes over that set's counts and corrects
  them by the few shingles in which the two differ.
* Sets that share a shingle of their prefixes (the rarest shingles that any
  partner must hold one of) and have no sketch in common are compared pair by
  pair, if the parities of their shingles by place in a bit map do not already
  differ more often than a link allows.

Only links that connect something new in a task are passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_map, stored, whole_rows
from .words import U64, mix, pieces, shingle_hashes, utf8, word_hashes, word_spans

PIECE = 1 << 20
SKETCH_BITS = 20
#: Prefix shingles are counted by slot; slots of several sets are marked in a map of so many bits (16 MB).
SLOT_BITS, MAP_BITS = 31, 27
#: A shingle counts as frequent from this many documents of a task's batch on.
OFTEN = 4
SEEDS, FACTOR = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)), U64(0x9E3779B97F4A7C15)
SKETCHES = tuple(f"m{k}" for k in range(1, 2 * len(SEEDS) + 3))
SKETCH_FIELDS = ", ".join(f"{m} long" for m in SKETCHES)
SETS = f"key long, version long, n long, f long, {SKETCH_FIELDS}, parity array<long>"
#: Rows (block, set) that are broadcast to find their texts, at about 100 bytes each; beyond it both sides are dealt.
BROADCAST_ROWS = 400_000


@dataclass(frozen=True)
class Settings:
    """Sets of ``words``-word shingles are linked from ``percent`` of their union on.

    A block holds about ``block_shingles`` shingles; larger groups are compared
    block against block.
    """

    words: int = 3
    percent: int = 90
    block_shingles: int = 1 << 20
    #: A list of the prefix index is dealt in parts of about so many sets, every two parts together.
    list_sets: int = 512


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Sets:
    """The distinct shingles of the texts of a batch, sorted per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        starts, ends, first = word_spans(data, offsets)
        hashes, owner = shingle_hashes(word_hashes(data, starts, ends), first, size)
        texts = len(offsets) - 1
        order = np.argsort(owner, kind="stable")
        hashes, counts = hashes[order], np.bincount(owner, minlength=texts)
        at = np.concatenate([[0], np.cumsum(counts)])
        each = [np.unique(hashes[at[i]:at[i + 1]]) for i in range(texts)]
        self.n = np.array([len(x) for x in each], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.shingles = np.concatenate(each) if each else np.zeros(0, U64)

    def reduced(self, function: Callable, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n), U64)
        full = np.flatnonzero(self.n)
        if len(full):
            out[full] = function.reduceat(values, self.at[:-1][full])
        return out

    def fingerprint(self) -> np.ndarray:
        return signed(mix(self.reduced(np.add, mix(self.shingles)) + self.n.astype(U64)))

    def parities(self) -> pa.ListArray:
        """Of every set a map of about as many bits as it has shingles, each telling whether an odd number of them falls there.

        A shingle that only one of two sets holds turns one bit, so maps differ
        in at most as many bits as the sets in shingles. Lengths are powers of
        two; a map folds onto one of half its length.
        """
        bits = np.int64(64) << np.ceil(np.log2(np.maximum(self.n, 64) / 64)).astype(np.int64)
        bits[self.n == 0] = 0
        first = np.concatenate([[0], np.cumsum(bits)])
        owner = np.repeat(np.arange(len(self.n)), self.n)
        place = first[owner] + (self.shingles & (bits[owner] - 1).astype(U64)).astype(np.int64)
        odd = (np.bincount(place, minlength=int(first[-1])) & 1).astype(np.uint8)
        words = np.packbits(odd, bitorder="little").view("<i8")
        return pa.ListArray.from_arrays(pa.array((first // 64).astype(np.int32)), pa.array(words))

    def sketches(self) -> list[np.ndarray]:
        """Numbers that sets much alike are likely to share: of each hash the two smallest and the two largest."""
        out, full = [], np.flatnonzero(self.n)
        first, last, more = self.at[:-1][full], self.at[1:][full] - 1, self.n[full] > 1
        ends = [(self.shingles[first], self.shingles[first + more]), (self.shingles[last], self.shingles[last - more])]
        for seed in SEEDS if len(full) else ():
            other = mix(self.shingles ^ seed)
            for function, none in ((np.minimum, U64(0xFFFFFFFFFFFFFFFF)), (np.maximum, U64(0))):
                end = function.reduceat(other, first)
                rest = np.where(other == np.repeat(end, self.n[full]), none, other)
                ends.append((end, function.reduceat(rest, first)))
        for k in range(len(SKETCHES)):
            made = np.zeros(len(self.n), U64)
            if len(full):
                made[full] = mix(ends[k][0] * FACTOR + ends[k][1])
            out.append(signed(made))
        return out


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _batch_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = utf8(column)
    for a, b in pieces(offsets, PIECE):
        yield a, b, Sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)


def describe(rows: DataFrame, settings: Settings) -> DataFrame:
    """Per row (key, version, text): SETS as kind 0, and how often buckets of shingles recur, as kind 1 (f, n)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["kind", "key", "version", "n", "f", *SKETCHES, "parity"]
        for batch in batches:
            seen, unlike = [], set()
            for a, b, sets in _batch_sets(batch.column(2), settings.words):
                f = sets.fingerprint()
                for i in range(b - a):
                    if int(f[i]) not in unlike:
                        unlike.add(int(f[i]))
                        seen.append(sets.shingles[sets.at[i]:sets.at[i + 1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(b - a, np.int32)), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array(sets.n), pa.array(f), *map(pa.array, sets.sketches()), sets.parities()], names)
            if seen:
                kinds, count = np.unique(np.concatenate(seen), return_counts=True)
                some = count >= OFTEN
                often += np.bincount(_bucket(kinds[some]), count[some], len(often)).astype(np.int64)
        some = np.flatnonzero(often)
        none = pa.array([None] * len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int32)), none, none, pa.array(often[some]),
                                          pa.array(some), *[none] * len(SKETCHES), pa.array([None] * len(some), pa.list_(pa.int64()))], names)

    return arrow_map(rows.select("key", "version", "text"), make, "kind int, " + SETS)


def links(n: np.ndarray, at: np.ndarray, shingles: np.ndarray, block: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets of one block with at least ``percent`` of their union in common, enough to connect all that are.

    Sets are ordered by (block, size). An index list holds positions; a probe
    reads only those after its own whose sizes can match.
    """
    total = len(n)
    owner = np.repeat(np.arange(total), n)
    salted = mix(shingles ^ mix(block.astype(U64) + U64(1))[owner])
    kinds, token, count = np.unique(salted, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[token] > 1)  # what only one set holds is in no overlap
    token, owner = token[shared], owner[shared]
    begin = np.searchsorted(owner, np.arange(total + 1))
    order = np.argsort(token, kind="stable")
    keys = token[order] * np.int64(total + 1) + owner[order]
    members = owner[order]
    last = np.searchsorted(block, block, "right")  # one past the block
    root = np.arange(total)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    def tally(tokens: np.ndarray, low: int, high: int, base: int, size: int) -> np.ndarray:
        """How often each position of [low, high) stands in the lists, counted from ``base``."""
        if len(tokens) == 0 or low >= high:
            return np.zeros(size, np.int64)
        head = tokens * np.int64(total + 1)
        a, b = np.searchsorted(keys, head + low), np.searchsorted(keys, head + high)
        width = b - a
        flat = np.repeat(a - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        return np.bincount(members[flat] - base, minlength=size)

    # (of the block, from position, up to, counts, tokens): the answers of the probe before
    known: tuple[int, int, int, np.ndarray, np.ndarray] | None = None
    for i in range(total):
        mine = np.sort(token[begin[i]:begin[i + 1]])
        if len(mine) == 0 or last[i] <= i + 1:
            continue
        reach = i + 1 + int(np.searchsorted(n[i + 1:last[i]] * percent, n[i] * 100, "right"))
        size = reach - i - 1
        if size <= 0:
            continue
        counts = None
        if known is not None and known[0] == block[i] and size > 32:
            _, low, high, before, theirs = known
            gone, come = np.setdiff1d(theirs, mine, True), np.setdiff1d(mine, theirs, True)
            if 2 * (len(gone) + len(come)) < len(mine) and low <= i + 1 <= high:
                counts = np.zeros(size, np.int64)
                counts[:high - i - 1] = before[i + 1 - low:]
                counts += tally(come, i + 1, high, i + 1, size) - tally(gone, i + 1, high, i + 1, size)
                counts += tally(mine, high, reach, i + 1, size)
        if counts is None:
            counts = tally(mine, i + 1, reach, i + 1, size)
        known = (int(block[i]), i + 1, reach, counts, mine)
        union = n[i] + n[i + 1:reach] - counts
        for j in (np.flatnonzero(100 * counts >= percent * union) + i + 1).tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield i, j


def _compare(percent: int, size: int, most: int):
    """Rows (block, f, text) sorted by block to links (a, b): whole blocks at a time."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        column = rows["text"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        parts = [s for _, _, s in _batch_sets(column, size)]
        f, block = rows["f"].to_numpy(), rows["block"].to_numpy()
        n = np.concatenate([s.n for s in parts])
        at = np.concatenate([[0], np.cumsum(n)])
        shingles = np.concatenate([s.shingles for s in parts])
        order = np.lexsort((f, n, block))
        twice = np.zeros(len(order), bool)
        twice[1:] = (f[order][1:] == f[order][:-1]) & (block[order][1:] == block[order][:-1])
        order = order[~twice]
        flat = np.concatenate([shingles[at[i]:at[i + 1]] for i in order]) if len(order) else shingles
        n = n[order]
        pairs = list(links(n, np.concatenate([[0], np.cumsum(n)]), flat, _dense(block[order]), percent))
        a = np.array([p[0] for p in pairs], np.int64)
        b = np.array([p[1] for p in pairs], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(f[order][a]), pa.array(f[order][b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            block = rows["block"].to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                yield found(rows.slice(0, cut))
                rest = rows.slice(cut)
                held, size = rest.to_batches(), rest.nbytes
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _dense(block: np.ndarray) -> np.ndarray:
    """Blocks in order as 0, 1, 2, ..."""
    out = np.zeros(len(block), np.int64)
    out[1:] = np.cumsum(block[1:] != block[:-1])
    return out


def compared(rows: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) within the blocks of rows (block, f, text)."""
    dealt = rows.select("block", "f", "text").repartition("block").sortWithinPartitions("block")
    return arrow_map(dealt, _compare(settings.percent, settings.words, 8 << 20), "a long, b long")


def blocks_of(reps: DataFrame, settings: Settings) -> DataFrame:
    """(block, f, key, version): every group of sets with one sketch, in blocks of bounded size.

    A group of more than ``block_shingles`` is cut into parts and every two
    parts are a block, so that any two sets of a group meet. Groups of the same
    sets, by the count, the sizes and a hash of all, are compared once.
    """
    turns = [x for k, m in enumerate(SKETCHES) for x in (F.lit(k), F.col(m))]
    each = reps.where(F.col("n") > 0).select("f", "key", "version", "n", F.stack(F.lit(len(SKETCHES)), *turns).alias("turn", "m"))
    groups = each.groupBy("turn", "m").agg(
        F.count("*").alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("f")).alias("who")).where(F.col("members") > 1)
    groups = groups.groupBy("members", "total", "who").agg(F.min(F.struct("turn", "m")).alias("at")).select("total", "at.turn", "at.m")
    parts = F.greatest(F.lit(1), F.ceil(F.col("total") / settings.block_shingles)).cast("long")
    groups = stored(groups.withColumn("parts", parts), "block-groups")
    each = each.join(groups, ["turn", "m"])
    mine = F.pmod(F.xxhash64("f"), F.col("parts"))
    each = each.withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    block = F.xxhash64("turn", "m", F.least("part", "other"), F.greatest("part", "other"))
    return each.select(block.alias("block"), "f", "key", "version")


def _prefixes(column: pa.Array, rank: np.ndarray, settings: Settings) -> Iterator[tuple[Sets, np.ndarray, np.ndarray, np.ndarray]]:
    """(sets, set, shingle, position) of the prefix of every text's set, frequent shingles last."""
    for _, _, sets in _batch_sets(column, settings.words):
        owner = np.repeat(np.arange(len(sets.n)), sets.n)
        order = np.lexsort((sets.shingles, rank[_bucket(sets.shingles)], owner))
        length = sets.n - (settings.percent * sets.n + 99) // 100 + 1
        pos = np.arange(len(owner)) - sets.at[:-1][owner]
        kept = pos < length[owner]
        yield sets, owner[kept], sets.shingles[order][kept], pos[kept]


def _slot(shingles: np.ndarray) -> np.ndarray:
    """A shingle's slot when prefixes are counted."""
    return (mix(shingles) >> U64(64 - SLOT_BITS)).astype(np.int64)


def _bit(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bit) of a slot in the map of shared slots."""
    at = mix(slots.astype(U64) * FACTOR) >> U64(64 - MAP_BITS)
    return (at >> U64(6)).astype(np.int64), at & U64(63)


def shared_slots(rows: DataFrame, rank, settings: Settings) -> np.ndarray:
    """A map of fixed size with a bit for every slot that shingles of several different sets' prefixes fall in.

    A shingle whose bit is not set is in one prefix only and brings no partner.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets, owner, shingles, _ in _prefixes(batch.column(0), rank.value, settings):
                yield pa.RecordBatch.from_arrays([pa.array(_slot(shingles).astype(np.int32)), pa.array(sets.fingerprint()[owner])],
                                                 ["slot", "of"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = _bit(batch.column(0).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(signed(U64(1) << bit))], ["word", "bits"])

    held = arrow_map(rows.select("text"), slots, "slot int, of long").groupBy("slot").agg(
        F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("slot")
    found = arrow_map(held, bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), U64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(U64)
    return out


def postings(rows: DataFrame, rank, shared, settings: Settings) -> DataFrame:
    """(shingle, f, n, pos and sketches) of the prefix of every set, without shingles of one prefix only."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets, owner, shingles, pos in _prefixes(batch.column(0), rank.value, settings):
                word, bit = _bit(_slot(shingles))
                kept = (shared.value[word] >> bit) & U64(1) > 0
                owner, shingles, pos = owner[kept], shingles[kept], pos[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(shingles)), pa.array(sets.fingerprint()[owner]), pa.array(sets.n[owner].astype(np.int32)),
                     pa.array(pos.astype(np.int32)), *(pa.array(m[owner]) for m in sets.sketches())],
                    ["shingle", "f", "n", "pos", *SKETCHES])

    return arrow_map(rows.select("text"), make, f"shingle long, f long, n int, pos int, {SKETCH_FIELDS}")


def dealt(listed: DataFrame, settings: Settings) -> DataFrame:
    """Postings with ``own``; ``shingle`` names the list that each goes to.

    Lists are counted as they are. One of more than ``list_sets`` sets is cut
    into parts by the set, and a set goes to the lists of its part with every
    part. ``own`` is its part where two different parts meet, else -1: there
    sets of one part have nothing to do with each other.
    """
    long_lists = listed.groupBy("shingle").agg(F.count("*").alias("sets")).where(F.col("sets") > settings.list_sets)
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.col("sets") / settings.list_sets))).cast("long")
    long_lists = stored(long_lists.select("shingle", parts.alias("parts")), "long-lists")
    found = listed.join(_small(long_lists), "shingle", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    found = found.withColumn("mine", F.pmod("f", "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return found.select(F.when(F.col("parts") > 1, F.xxhash64("shingle", low, high)).otherwise(F.col("shingle")).alias("shingle"),
                        F.when(low < high, F.col("mine")).otherwise(-1).cast("int").alias("own"), "f", "n", "pos", *SKETCHES)


def candidates(listed: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) that share a prefix shingle, can match by size and position, and have no sketch in common."""
    percent = settings.percent

    def pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        shingle, own, f, n, pos, *sketches = (t[c].to_numpy() for c in ("shingle", "own", "f", "n", "pos", *SKETCHES))
        order = np.lexsort((f, n, shingle))
        once = np.ones(len(f), bool)
        once[1:] = (f[order][1:] != f[order][:-1]) | (shingle[order][1:] != shingle[order][:-1])
        order = order[once]
        shingle, own, f, n, pos = shingle[order], own[order], f[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        sketches = [m[order] for m in sketches]
        out_a, out_b = [], []
        end = np.searchsorted(shingle, shingle, "right")
        step = 1
        alive = np.arange(len(f))
        while True:  # each set with the one ``step`` after it in the list, until sizes no longer match
            alive = alive[alive + step < end[alive]]
            alive = alive[n[alive + step] * percent <= n[alive] * 100]
            if len(alive) == 0:
                break
            a, b = alive, alive + step
            need = -(-percent * (n[a] + n[b]) // (100 + percent))
            can = np.minimum(n[a] - pos[a], n[b] - pos[b]) + np.minimum(pos[a], pos[b]) >= need
            good = can & ((own[a] < 0) | (own[a] != own[b]))
            for m in sketches:
                good &= m[a] != m[b]
            out_a.append(f[a[good]])
            out_b.append(f[b[good]])
            step += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 200_000:
                continue
            t = pa.Table.from_batches(held)
            shingle = t["shingle"].to_numpy()
            cut = int(np.searchsorted(shingle, shingle[-1]))
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(t.slice(0, cut))], ["a", "b"])
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(pa.Table.from_batches(held))], ["a", "b"])

    ordered = listed.repartition("shingle").sortWithinPartitions("shingle")
    return arrow_map(ordered, run, "a long, b long").distinct()


def _small(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def with_texts(picked: DataFrame, rows: DataFrame) -> DataFrame:
    """``picked(key, version, ..)`` with the text of each, from ``rows(key, version, text)``."""
    p, r = picked.alias("p"), rows.alias("r")
    return p.join(r, F.col("p.key").eqNullSafe(F.col("r.key")) & (F.col("p.version") == F.col("r.version"))).select("p.*", "r.text")


def class_texts(reps: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(f, key, version, text): one text of every class, however often its row is there.

    Where there are too many classes to find their texts by a broadcast, the texts are stored, as they are read twice.
    """
    picked = stored(reps.select("f", "key", "version"), "picked")
    few = picked.count() <= BROADCAST_ROWS
    found = with_texts(F.broadcast(picked) if few else picked, rows)
    if sets.groupBy("key", "version").agg(F.count("*").alias("times")).where("times > 1").limit(1).count():
        return stored(found.dropDuplicates(["f"]), "class-texts")
    return found if few else stored(found, "class-texts")


def not_apart(pairs: DataFrame, reps: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose maps of parities do not differ in more bits than a link allows shingles to differ."""
    a, b = (reps.select(F.col("f").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}")) for x in "ab")
    both = F.col("n_a") + F.col("n_b")
    allowed = both - 2 * F.ceil(settings.percent * both / (100 + settings.percent))
    short, long = F.least(F.size("p_a"), F.size("p_b")), F.greatest(F.size("p_a"), F.size("p_b"))

    def folded(x: str, i) -> Column:
        return F.get(x, i).bitwiseXOR(F.coalesce(F.get(x, i + short), F.lit(0).cast("long")))

    differ = F.aggregate(F.sequence(F.lit(0), short - 1), F.lit(0), lambda total, i: total + F.bit_count(
        folded("p_a", i).bitwiseXOR(folded("p_b", i))))
    return pairs.join(a, "a").join(b, "b").where((long > 2 * short) | (differ <= allowed)).select("a", "b")


def join_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, version, n_shingles, class_id, component_id, root) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. ``class_id`` is the smallest
    id with an equal set, ``component_id`` the smallest that links reach. A
    text with fewer words than a shingle has one shingle of all of them; a null
    text or one without words has none and is linked with nothing, not even
    with its like. ``version`` is the xxhash64 of the text; rows that repeat an
    id share what their sets have. ``root`` names the component by a hash, null
    where there is no shingle. A null id is no candidate for an id: a
    component of such rows only has a null one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    made = stored(describe(rows, settings), "sets", "kind")
    sets = made.where(F.col("kind") == 0).drop("kind")
    counted = made.where(F.col("kind") == 1).groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    rank = np.zeros(1 << SKETCH_BITS, np.int8)
    rank[counted["f"].to_numpy()] = np.log2(counted["n"].to_numpy().astype(np.float64) + 1).astype(np.int8)
    sketch = spark.sparkContext.broadcast(rank)
    reps = stored(sets.where(F.col("n") > 0).groupBy("f").agg(
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "version")).alias("rep"), F.max("n").alias("n"),
        *(F.max(m).alias(m) for m in SKETCHES), F.first("parity").alias("parity")).select(
        "f", "rep.key", "rep.version", "n", *SKETCHES, "parity"), "classes")

    def texts(picked: DataFrame) -> DataFrame:
        """With the text of each (key, version)."""
        return with_texts(_small(stored(picked, "picked")), rows)

    near = stored(compared(texts(blocks_of(reps, settings)), settings), "links-blocks")
    chosen = class_texts(reps, sets, rows)
    shared = spark.sparkContext.broadcast(shared_slots(chosen, sketch, settings))
    listed = stored(postings(chosen, sketch, shared, settings), "postings")
    pairs = stored(candidates(dealt(listed, settings), settings), "candidates")
    pairs = stored(not_apart(pairs, reps, settings), "pairs")
    ends = pairs.select(F.xxhash64("a", "b").alias("block"), F.explode(F.array("a", "b")).alias("f"))
    ends = ends.join(reps.select("f", "key", "version"), "f")
    far = stored(compared(texts(ends.select("block", "f", "key", "version")), settings), "links-pairs")
    roots = components(near.unionByName(far))
    named = reps.select("f", F.col("key").alias("class_id")).join(
        roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    smallest = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = stored(named.join(smallest, "root").select("f", "class_id", "component_id", "root"), "components")
    out = sets.join(named, "f", "left")
    alone = F.col("n") == 0
    return out.select("key", "version", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.col("key")).otherwise(F.col("component_id")).alias("component_id"), "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those of its smallest id, once.

    Of equal rows one stays, of different texts of one id in one component the
    one with the smallest xxhash64. Rows without a shingle all stay, but equal
    ones once. A component of null ids only keeps one row.
    """
    found = join_sets(docs, id_col, text_col, settings)
    group = F.when(F.col("n_shingles") > 0, F.struct(F.lit(0).alias("kind"), F.col("root").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(
        F.struct(F.lit(1).alias("kind"), F.col("key").alias("a"), F.col("version").alias("b")))
    best = found.groupBy(group.alias("group")).agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "version")).alias("best"))
    best = _small(stored(best.select(F.col("best.key").alias("kept_key"), F.col("best.version").alias("kept_version")).distinct(), "kept"))
    rows = whole_rows(docs)
    key, version = F.col(f"row.`{id_col}`").cast("long"), F.xxhash64(F.col(f"row.`{text_col}`"))
    kept = rows.join(best, key.eqNullSafe(F.col("kept_key")) & (version == F.col("kept_version")))
    return kept.groupBy("kept_key", "kept_version").agg(F.first("row").alias("row")).select("row.*")
