"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Word n-grams of the test items that are rare in the corpus are looked up in
every text, with one word more or less inside them too. Where several of them
meet at about one place, the text there and the item are aligned word by word
(Smith-Waterman), so copies with words changed, added or left out score as what
they still share. Where frequent
n-grams meet, it is aligned if the words there can reach the threshold at all.
Items go to the texts in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, stored, whole_rows
from .words import BYTE_LOWER, BYTE_VALUE, U64, mix, pieces, powers, utf8

PIECE = 2 << 20
HITS = "key long, version long, item long, score double, first_word long, last_word long"
#: Bytes of words: letters, digits and everything beyond ASCII; punctuation does not count.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


@dataclass(frozen=True)
class Settings:
    """``seed`` words make a seed, in a row or with one word between them left out; one is rare up to ``rare`` times the median frequency of the item's seeds that occur.

    Alignment gives 2 for a word shared, and takes 1 for a word changed, added
    or left out; a hit has at least ``threshold`` of what the item itself has.
    """

    seed: int = 3
    rare: float = 4.0
    threshold: float = 0.5
    block_words: int = 1 << 20


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and their number)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = IN_WORD[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    begin[borders] = inside[borders]
    end[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[BYTE_LOWER[data]] * powers(n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(n + 1, inverse=True)[starts] + (ends - starts).astype(U64))
    return hashes, np.searchsorted(starts, offsets)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last + 1) of the best local alignment; of equal ones that which starts and ends first."""
    m = len(words)
    unit, shift = np.int64(1 << 32), np.arange(m + 1, dtype=np.int64)
    fresh = (1 << 31) - shift  # the low half of a cell tells where its alignment starts
    above, best, end = fresh.copy(), np.int64(0), 0
    for w in item:
        step = np.where(words == w, 2, -1) * unit
        cell = np.maximum(fresh, above - unit)
        cell[1:] = np.maximum(cell[1:], above[:-1] + step)
        above = np.maximum.accumulate(cell + shift * unit) - shift * unit
        above = np.maximum(above, fresh)
        k = int(np.argmax(above))
        if above[k] > best:
            best, end = above[k], k
    score = int(best >> 32)
    start = (1 << 31) - int(best & 0xFFFFFFFF)
    return score, start, end


def shapes(size: int) -> list[tuple[int, ...]]:
    """Places of a seed's words: in a row, or with one left out inside."""
    return [tuple(range(size))] + [tuple(k for k in range(size + 1) if k != out) for out in range(1, size)]


def runs(words: np.ndarray, shape: tuple[int, ...], size: int) -> np.ndarray:
    """Hash of the words at ``shape`` from every word on; it tells which words follow each other, not where one is left out."""
    count = max(0, len(words) - shape[-1])
    made = np.full(count, len(shape) if len(shape) < size else 0, U64)
    for k in shape:
        made = mix(made * U64(0x9E3779B97F4A7C15) + words[k:count + k])
    return made


@dataclass
class Items:
    """A block of test items: their words, and their seeds by hash; all count as rare until they are counted.

    ``sieve`` tells by the low bits of a hash that it is no seed.
    """

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray
    rare: np.ndarray
    sizes: np.ndarray
    sieve: np.ndarray

    @staticmethod
    def of(ids: list, texts: pa.Array, size: int) -> Items:
        data, offsets = utf8(texts)
        words, first = plain_words(data, offsets)
        lengths = np.diff(first)
        found = []
        # items shorter than a seed are one seed as a whole
        for shape in shapes(size) + [tuple(range(n)) for n in range(1, size)]:
            made = runs(words, shape, size)
            at = np.arange(len(made))
            owner = np.searchsorted(first, at, "right") - 1
            fits = at + shape[-1] < first[owner + 1]
            if len(shape) < size:
                fits &= lengths[owner] == len(shape)
            found.append((made[fits], owner[fits], (at - first[owner])[fits]))
        hashes, owner, at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(hashes, kind="stable")
        sieve = np.zeros(1 << max(16, len(hashes).bit_length() + 2), bool)
        sieve[hashes & U64(len(sieve) - 1)] = True
        return Items(ids, [words[first[i]:first[i + 1]] for i in range(len(ids))], hashes[order], owner[order], at[order],
                     np.ones(len(order), bool), lengths, sieve)

    def judged(self, number: np.ndarray, rare: float) -> Items:
        """With the seeds that are rare by ``number``: against their item's median of those that occur, and its rarest."""
        order = np.lexsort((number, self.seed_item))
        order = order[number[order] > 0]
        bound = np.zeros(len(self.ids))
        begin = np.searchsorted(self.seed_item[order], np.arange(len(self.ids) + 1))
        for k in np.flatnonzero(np.diff(begin)):
            own = number[order[begin[k]:begin[k + 1]]]
            bound[k] = max(own[0], rare * np.median(own))
        return replace(self, rare=number <= np.maximum(1, bound[self.seed_item]))


def _text_seeds(words: np.ndarray, first: np.ndarray, items: Items, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position in the batch, place in items.seeds of its first equal) of seeds found in texts."""
    short = sorted({len(w) for w in items.words if 0 < len(w) < size})
    found = []
    for shape in shapes(size) + [tuple(range(n)) for n in short]:
        made = runs(words, shape, size)
        hit = np.flatnonzero(items.sieve[made & U64(len(items.sieve) - 1)])
        at = np.searchsorted(items.seeds, made[hit])
        same = at < len(items.seeds)
        same[same] = items.seeds[at[same]] == made[hit[same]]
        hit, at = hit[same], at[same]
        owner = np.searchsorted(first, hit, "right") - 1
        whole = hit + shape[-1] < first[owner + 1]
        found.append((owner[whole], hit[whole], at[whole]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _windows(text: int, words: np.ndarray, first: np.ndarray, at: np.ndarray, place: np.ndarray, items: Items,
             settings: Settings) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, last word) of the items that one text holds."""
    last = np.searchsorted(items.seeds, items.seeds[place], "right")
    count = last - place
    rows = np.repeat(place - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    item, begins, rare = items.seed_item[rows], items.seed_at[rows], items.rare[rows]
    guess = np.repeat(at, count) - begins
    order = np.lexsort((guess, item))
    item, begins, rare, guess = item[order], begins[order], rare[order], guess[order]
    # seeds of an item on about one diagonal are a group
    size = items.sizes[item]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (np.diff(guess) > size[1:] // 2 + 8)
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    order = np.lexsort((begins, group))
    once = np.ones(len(item), bool)
    once[1:] = (group[order][1:] != group[order][:-1]) | (begins[order][1:] != begins[order][:-1])
    once = order[once]
    kinds, few = np.bincount(group[once], minlength=len(start)), np.bincount(group[once], rare[once], len(start))
    need = np.minimum(2, np.maximum(1, size[start] - settings.seed + 1))
    stop = np.append(start[1:], len(item)) - 1
    best = None
    for g in np.flatnonzero(kinds >= need):
        k, words_k = int(item[start[g]]), items.words[item[start[g]]]
        size_k, pad = len(words_k), len(words_k) // 4 + 4
        low = max(int(first[text]), int(guess[start[g]]) - pad)
        high = min(int(first[text + 1]), int(guess[stop[g]]) + size_k + pad)
        if few[g] < need[g] and np.isin(words_k, words[low:high]).sum() < settings.threshold * size_k:
            continue  # no alignment shares more words than occur there
        score, begin, end = align(words_k, words[low:high])
        share = score / (2 * size_k)
        if best is not None and best[0] != k:
            yield best
            best = None
        if share >= settings.threshold and (best is None or share > best[1]):
            best = (k, share, low + begin - int(first[text]), low + end - 1 - int(first[text]))
    if best is not None:
        yield best


def _blocks(bench: DataFrame, id_col: str, text_col: str, settings: Settings) -> Iterator[Items]:
    """The items in blocks of about ``block_words`` words, cut by a hash of the item."""
    size = bench.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    number = max(1, -(-size // (4 * settings.block_words)))
    rows = bench.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    rows = stored(rows.distinct().withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(number)).cast("int")), "items", "block")
    for b in range(number):
        held = rows.where(F.col("block") == b).select("item", "text").orderBy("item", "text").toArrow()
        if held.num_rows:
            yield Items.of(held["item"].to_pylist(), held["text"].combine_chunks(), settings.seed)


def find_items(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, version, item, score, first_word, last_word): the items that each row's text holds, and where.

    ``version`` is the xxhash64 of the text: with the id it tells the row. One
    row per text and item, with the best place; words are counted from 0
    without punctuation. Two different seeds must meet, or one if the item has
    no more. Seeds are counted over all documents, by document; where fewer
    rare ones meet, the place is aligned all the same unless too few of the
    item's words occur there, so rarity decides the cost only. Null and empty texts and items
    without a word give nothing; equal rows give equal hits once.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    found = None
    for items in _blocks(bench, item_col, item_text_col, settings):
        every = sc.broadcast(items)

        def counts(batches: Iterator[pa.RecordBatch], every=every) -> Iterator[pa.RecordBatch]:
            number = np.zeros(len(every.value.seeds), np.int64)
            for batch in batches:
                data, offsets = utf8(batch.column(0))
                for a, b in pieces(offsets, PIECE):
                    words, first = plain_words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    text, _, place = _text_seeds(words, first, every.value, settings.seed)
                    if len(text):
                        number += np.bincount(np.unique(text * len(number) + place) % len(number), minlength=len(number))
            some = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(number[some])], ["place", "n"])

        partial = arrow_map(rows.select("text"), counts, "place long, n long")
        met = partial.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        number = np.zeros(len(items.seeds), np.int64)
        number[met["place"].to_numpy()] = met["n"].to_numpy()
        number = number[np.searchsorted(items.seeds, items.seeds)]  # equal seeds are counted at their first place
        judged = sc.broadcast(items.judged(number, settings.rare))
        every.unpersist()

        def hits(batches: Iterator[pa.RecordBatch], judged=judged) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, versions = batch.column(0), batch.column(1)
                data, offsets = utf8(batch.column(2))
                out = []
                for a, b in pieces(offsets, PIECE):
                    words, first = plain_words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    text, at, place = _text_seeds(words, first, judged.value, settings.seed)
                    order = np.argsort(text, kind="stable")
                    text, at, place = text[order], at[order], place[order]
                    cuts = np.flatnonzero(np.diff(text)) + 1
                    for t, w, p in zip(text[np.r_[0, cuts]] if len(text) else (), np.split(at, cuts), np.split(place, cuts)):
                        for k, score, low, high in _windows(int(t), words, first, w, p, judged.value, settings):
                            out.append((keys[a + int(t)].as_py(), versions[a + int(t)].as_py(), judged.value.ids[k], score, low, high))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 [x.split()[0] for x in HITS.split(", ")])

        part = arrow_map(rows, hits, HITS)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], HITS)
    return found.groupBy("key", "version", "item").agg(
        F.max(F.struct("score", "first_word", "last_word")).alias("best")).select("key", "version", "item", "best.*")


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``row`` of every row whose text holds no item; every column of ``docs`` is in it."""
    hits = find_items(docs, bench, id_col, text_col, **options).select("key", "version").distinct()
    rows = whole_rows(docs)
    return rows.join(hits, F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("key"))
                     & (F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("version")), "left_anti")
