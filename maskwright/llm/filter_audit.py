"""How filters that follow one another interact: what each removes, in every order.

A document fails a set of the filters: its mask. Spark counts documents by part
and mask, so a part is at most ``2 ** filters`` cells. Over the cells runs a
Gray-code walk through all subsets of filters: every step toggles one filter,
which raises or lowers the active-failure counter of the cells that fail it; a
cell whose counter leaves or reaches zero leaves or joins the running survivors.
The survivors of every subset are stored; any step of any order of the filters
is the difference of two of these states.

Nulls: a null text is an empty one, a null part is the empty string, a null id
is no other id's smaller one, has no label and never fails the filter for
repeated texts. Rows that repeat an id count each; with the same text they are
no repeats of one another. Several labels of an id: any of them suffices. Texts
are read whole; a very long one is one row's array of words. Other columns are
not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import let

from .shared import BLANK_CHARS, BLANKS, arrow_map, stored

#: What is counted of the documents in a cell.
MEASURES = ("kept", "good", "toxic")


def words_of(text: Column) -> Column:
    """Maximal runs of other than white space; of a text without one, an array of one empty string."""
    return F.split(F.btrim(text, F.lit(BLANK_CHARS)), BLANKS + "+", -1)


def text_filters(text: Column, least_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5) -> Column:
    """The bits of the filters A to D that a text fails: short, monotonous, shouting, with symbols."""
    def bit(k: int, fails: Column) -> Column:
        return F.when(fails, F.lit(1 << k)).otherwise(F.lit(0))

    def of_words(words: Column) -> Column:
        n = F.when(F.element_at(words, 1) == "", F.lit(0)).otherwise(F.size(words)).cast("long")
        few = 100 * F.size(F.array_distinct(words)).cast("long") < distinct_percent * n
        return bit(0, n < least_words) + bit(1, few)

    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return (let(words_of(text), of_words) + bit(2, 100 * capitals > capital_percent * F.char_length(text).cast("long"))
            + bit(3, text.rlike("[#$%&*|]")))


def cells(docs: DataFrame, labels: DataFrame, mask: Column, repeats_bit: int, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """(part, mask, kept, good, toxic): documents by what they fail, and those of them labelled so.

    ``mask`` is the filters that a row fails by itself. Bit ``repeats_bit`` is
    added where the text is identical to that of a smaller id. Texts meet by
    their SHA-256. Copies are added up by id, then by text and part, before
    they meet, so a text has as many rows in one place as it has parts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("text_id"), mask.alias("mask"))
    rows = rows.groupBy("doc", "text_id", "part", "mask").agg(F.count("*").alias("n"))
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("is_good"), F.max((F.col("toxic") == 1).cast("long")).alias("is_toxic"))
    known = rows.where(F.col("doc").isNotNull()).join(named, "doc", "left")
    counts = [F.col("n").alias("kept"), (F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
              (F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic")]
    known = known.select("doc", "text_id", "part", "mask", *counts)
    # one row per text and part; the counts of its smallest id apart, as only these may be no repeats
    groups = stored(known.groupBy("text_id", "part", "mask").agg(
        *(F.sum(m).alias(m) for m in MEASURES), F.min(F.struct("doc", *MEASURES)).alias("first")), "texts")
    least = groups.groupBy("text_id").agg(F.min("first.doc").alias("least"))
    groups = groups.join(least, "text_id")
    is_first = F.col("first.doc") == F.col("least")
    first = [F.when(is_first, F.col(f"first.{m}")).otherwise(F.lit(0)).alias(m) for m in MEASURES]
    rest = [(F.col(m) - F.when(is_first, F.col(f"first.{m}")).otherwise(F.lit(0))).alias(m) for m in MEASURES]
    both = groups.select("part", F.inline(F.array(
        F.struct(F.col("mask"), *first), F.struct((F.col("mask") + (1 << repeats_bit)).alias("mask"), *rest))))
    nameless = rows.where(F.col("doc").isNull()).select(
        "part", "mask", F.col("n").alias("kept"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return both.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(m).alias(m) for m in MEASURES))


def gray_walk(counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors [part, subset of filters, measure] from counts [part, mask, measure].

    Subsets follow one another by a toggle of one filter, as the bits of the
    Gray code do; the counters of the cells are the same for every part.
    """
    subsets = 1 << filters
    masks = np.arange(subsets)
    failures = np.zeros(subsets, np.int64)
    alive = counts.sum(axis=1)
    out = np.empty_like(counts)
    out[:, 0] = alive
    subset = 0
    for k in range(1, subsets):
        toggled = k & -k
        subset ^= toggled
        mine = (masks & toggled) != 0
        if subset & toggled:
            leave = mine & (failures == 0)
            failures[mine] += 1
            alive = alive - counts[:, leave].sum(axis=1)
        else:
            failures[mine] -= 1
            join = mine & (failures == 0)
            alive = alive + counts[:, join].sum(axis=1)
        out[:, subset] = alive
    return out


def states(found: DataFrame, filters: int) -> DataFrame:
    """(part, kept, good, toxic, shapley): one row per part, arrays over the subsets of filters by their bits.

    ``shapley`` has for every filter what it removes, summed over all orders.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << filters
        orders = [factorial(bin(s).count("1")) * factorial(filters - 1 - bin(s).count("1")) if s < size - 1 else 0 for s in range(size)]
        for batch in batches:
            parts = batch.num_rows
            if parts == 0:
                continue
            flat = batch.column(1).flatten()
            owner = np.repeat(np.arange(parts), batch.column(1).value_lengths().to_numpy())
            counts = np.zeros((parts, size, len(MEASURES)), np.int64)
            for k, m in enumerate(MEASURES):
                counts[owner, flat.field("mask").to_numpy(), k] = flat.field(m).to_numpy()
            alive = gray_walk(counts, filters)
            share = np.zeros((parts, filters), np.int64)
            for f in range(filters):
                for s in range(size):
                    if not s & (1 << f):
                        share[:, f] += orders[s] * (alive[:, s, 0] - alive[:, s | (1 << f), 0])
            lists = [_lists(alive[:, :, k]) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, _lists(share)], ["part", *MEASURES, "shapley"])

    grouped = found.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    return arrow_map(grouped, walk, "part string, " + ", ".join(f"{m} array<long>" for m in (*MEASURES, "shapley")))


def _lists(table: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32), pa.array(table.ravel()))


def steps(stored_states: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row per part, order of ``letters`` and step: differences of two stored states.
    """
    rows = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order):
            name = "".join(letters[x] for x in order)
            rows.append(f"struct('{name}' AS filter_order, {step + 1} AS step, {f} AS f, {before} AS before, {before | (1 << f)} AS after)")
            before |= 1 << f
    every = (1 << len(letters)) - 1
    laid = stored_states.select("part", *MEASURES, "shapley", F.expr(f"inline(array({', '.join(rows)}))"))

    def lost(measure: str, before: Column, after: Column) -> Column:
        return F.get(measure, before) - F.get(measure, after)

    bit = F.col("after") - F.col("before")
    removed = lost("kept", F.col("before"), F.col("after"))
    return laid.select(
        "part", "filter_order", "step", F.get("kept", F.col("after")).alias("kept"), removed.alias("removed"),
        (lost("kept", F.lit(0), bit) - removed).alias("redundant"), lost("kept", F.lit(every) - bit, F.lit(every)).alias("unique_fails"),
        lost("good", F.col("before"), F.col("after")).alias("good_lost"),
        lost("toxic", F.col("before"), F.col("after")).alias("toxic_lost"), F.get("shapley", F.col("f")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The steps of all orders of the filters A to E, per part of ``docs``."""
    letters = "ABCDE"
    mask = text_filters(F.coalesce(F.col(text_col), F.lit("")))
    found = cells(docs, labels, mask, letters.index("E"), id_col, text_col, part_col)
    return steps(stored(states(found, len(letters)), "states"), letters)
