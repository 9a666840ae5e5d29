"""Language ID by interpolated Kneser-Ney character models, one per language.

A model predicts each letter of a word, and the word's end, from the three
symbols before it in the word. Counts and continuation counts of all training
texts are made and discounted in Spark; the probabilities and back-off weights
land in sorted arrays of n-gram codes, which are exact. A text goes to the language of the
lowest cross-entropy per symbol, and is rejected if even that is far above
what the language's training texts have.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, stored, whole_rows, with_fields
from .words import characters, pieces, utf8

ORDER = 4
#: Bytes of text that are turned into arrays at once; a longer text is cut behind a character that is no letter.
PIECE = 1 << 19
#: Distinct n-grams a task holds before it passes its counts on.
HELD = 1 << 21

#: Letters beyond the base plane get symbols that no letter has there, one for every 32 of them.
FAR_SYMBOLS, FAR_PLANES, FAR_BITS = 0xD800, 0x30000, 5

_symbols: dict[str, np.ndarray] = {}


def symbols() -> tuple[np.ndarray, np.ndarray]:
    """(symbol per code point of the base plane, is it a mark); the symbol is the lower-case letter, 0 for what is no letter."""
    if "base" not in _symbols:
        table, marks = np.zeros(0x10000, np.uint16), np.zeros(0x10000, bool)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 and ord(low) < 0xFFFF else i
            elif 0x300 <= i and unicodedata.category(c)[0] == "M":
                table[i], marks[i] = i, True
        _symbols["base"], _symbols["marks"] = table, marks
    return _symbols["base"], _symbols["marks"]


def far_symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points beyond the base plane."""
    if "far" not in _symbols:
        _symbols["far"] = np.array([(FAR_SYMBOLS + ((i - 0x10000) >> FAR_BITS)) if chr(i).isalpha() else 0
                                    for i in range(0x10000, FAR_PLANES)], np.uint16)
    return np.where(points < FAR_PLANES, _symbols["far"][np.minimum(points, FAR_PLANES - 1) - 0x10000], 0)


def ngram_codes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): the n-gram that ends at every letter and word end, 16 bits a symbol.

    A symbol before the word counts as 0. Runs of other characters are one word
    end. A mark counts where it follows a letter. A text without a letter has no
    code.
    """
    n, texts = len(points), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    base, is_mark = symbols()
    near = np.minimum(points, 0xFFFF)
    sym, mark = base[near], is_mark[near]
    far = np.flatnonzero(points > 0xFFFF)
    sym[far], mark[far] = far_symbols(points[far]), False
    # a border after each text
    at = np.arange(n) + np.repeat(np.arange(texts), np.diff(offsets))
    row = np.zeros(n + texts, np.uint16)
    row[at] = sym
    if mark.any():
        marks = np.zeros(n + texts, bool)
        marks[at] = mark
        holder = np.maximum.accumulate(np.where(marks, -1, np.arange(n + texts)))  # what the marks stand on
        row[marks & ((holder < 0) | (row[holder] == 0))] = 0
    starts = offsets + np.arange(texts + 1)
    keep = row != 0
    keep[1:] |= row[:-1] != 0
    begun = np.zeros(n + texts, bool)
    begun[starts[:-1]] = True
    keep &= ~(begun & (row == 0))
    kept = np.zeros(n + texts + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    row = row[keep]
    code = row.astype(np.int64)
    letter = np.ones(len(row), bool)
    for back in range(1, ORDER):
        before = np.zeros(len(row), np.int64)
        before[back:] = row[:-back]
        letter &= before != 0  # once a border is met, all before it counts as 0
        code |= np.where(letter, before, 0) << (16 * back)
    return code, kept[starts]


_PART_OF_WORD = np.ones(256, bool)
_PART_OF_WORD[:128] = [chr(i).isalpha() for i in range(128)]


def text_codes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last, codes, offsets) piece by piece; a long text comes in several, of one text each.

    A piece ends behind an ASCII character that is no letter. There a word ends
    anyway, so the codes are those of the whole text.
    """
    data, offsets = utf8(column)
    for a, b in pieces(offsets, PIECE):
        low, high = int(offsets[a]), int(offsets[b])
        while True:
            end = high
            if high - low > PIECE:
                end = low + PIECE
                while end < high:
                    cut = np.flatnonzero(~_PART_OF_WORD[data[end:min(high, end + PIECE)]])
                    if len(cut):
                        end += int(cut[0]) + 1
                        break
                    end = min(high, end + PIECE)
            points, at = characters(data[low:end], np.clip(offsets[a:b + 1], low, end) - low)
            yield a, b, *ngram_codes(points, at)
            low = end
            if low >= high:
                break


@dataclass
class Model:
    """Sorted arrays of n-gram codes per language and order; 12 bytes an n-gram or context."""

    languages: list[str]
    grams: dict = field(default_factory=dict)     # (language, order) -> (codes, probability above back-off)
    contexts: dict = field(default_factory=dict)  # (language, order) -> (codes, back-off weight)
    limits: dict = field(default_factory=dict)    # language -> (mean, deviation) of bits per symbol in training
    alphabet: int = 1 << 16

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """-log2 of each language's probability of the last symbol of each code: [language, code]."""
        out = np.empty((len(self.languages), len(codes)))
        for i, language in enumerate(self.languages):
            p = np.full(len(codes), 1.0 / self.alphabet)
            for order in range(1, ORDER + 1):
                part = codes & ((1 << 16 * order) - 1) if order < 4 else codes
                context = (part >> 16) & ((1 << 48) - 1) if order > 1 else np.zeros_like(part)
                p = _find(self.grams.get((language, order)), part, 0.0) + _find(
                    self.contexts.get((language, order)), context, 1.0) * p
            out[i] = -np.log2(np.maximum(p, 1e-12))
        return out


def _find(table, codes: np.ndarray, missing: float) -> np.ndarray:
    if table is None or len(table[0]) == 0:
        return np.full(len(codes), missing)
    keys, values = table
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, values[at], missing)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(list(held), dtype=object), [len(v[0]) for v in held.values()]), pa.string()),
             pa.array(np.concatenate([v[0] for v in held.values()] or [np.zeros(0, np.int64)]), pa.int64()),
             pa.array(np.concatenate([v[1] for v in held.values()] or [np.zeros(0, np.int64)]), pa.int64())],
            ["lang", "code", "n"])
        held.clear()
        return made

    for batch in batches:
        names = np.array(batch.column(1).to_pylist(), dtype=object)
        for a, b, codes, at in text_codes(batch.column(0)):
            owner = np.repeat(names[a:b], np.diff(at))
            for name in sorted(set(names[a:b])):
                found, n = np.unique(codes[owner == name], return_counts=True)
                if name in held:
                    both, where = np.unique(np.concatenate([held[name][0], found]), return_inverse=True)
                    found, n = both, np.bincount(where, np.concatenate([held[name][1], n])).astype(np.int64)
                held[name] = (found, n)
            if sum(len(v[0]) for v in held.values()) > HELD:
                yield flush()
    if held:
        yield flush()


def _tables(counts: DataFrame) -> DataFrame:
    """(lang, ord, kind, code, value) of all orders from (lang, code, n).

    ``kind`` 0: discounted probability of an n-gram, 1: back-off weight of a
    context, 2: the discount's language row is folded in already.
    """
    out, level = None, counts
    for order in range(ORDER, 0, -1):
        ones = level.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("double")).alias("n1"),
                                         F.sum((F.col("n") == 2).cast("double")).alias("n2"))
        off = ones.select("lang", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
                          .otherwise(0.5).alias("off"))
        off = off.withColumn("off", F.least(F.col("off"), F.lit(0.95)))
        context = F.shiftrightunsigned("code", 16) if order > 1 else F.lit(0).cast("long")
        rows = level.withColumn("context", context)
        sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        sums = sums.join(off, "lang")
        grams = rows.join(sums, ["lang", "context"]).select(
            "lang", F.lit(order).alias("ord"), F.lit(0).alias("kind"), "code",
            ((F.col("n") - F.col("off")) / F.col("total")).cast("float").alias("value"))
        weights = sums.select("lang", F.lit(order).alias("ord"), F.lit(1).alias("kind"),
                              F.col("context").alias("code"),
                              (F.col("off") * F.col("kinds") / F.col("total")).cast("float").alias("value"))
        both = grams.unionByName(weights)
        out = both if out is None else out.unionByName(both)
        if order > 1:  # continuation counts: in how many contexts the shorter n-gram occurs
            level = level.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("next")).agg(
                F.count("*").alias("n")).withColumnRenamed("next", "code")
    return out


def train(texts: DataFrame, text_col: str, lang_col: str) -> Model:
    """Models of all texts with a language; the arrays, as long as there are different n-grams, come to the driver."""
    rows = texts.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    partial = arrow_map(rows, _count_rows, "lang string, code long, n long")
    counts = stored(partial.groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
    made = _tables(counts).toArrow()
    if made.num_rows == 0:
        return Model([])
    names = pc.unique(made["lang"]).to_pylist()
    model = Model(sorted(names))
    lang = pc.index_in(made["lang"], pa.array(model.languages)).to_numpy()
    order, kind, keys, values = (made[c].to_numpy() for c in ("ord", "kind", "code", "value"))
    for i, name in enumerate(model.languages):
        for o in range(1, ORDER + 1):
            for k, into in ((0, model.grams), (1, model.contexts)):
                mine = np.flatnonzero((lang == i) & (order == o) & (kind == k))
                mine = mine[np.argsort(keys[mine], kind="stable")]
                into[name, o] = (keys[mine], values[mine])
    spread = counts.sparkSession.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            bits = spread.value.bits(codes)
            at = np.array([spread.value.languages.index(x) for x in names])
            own = bits[at, np.arange(len(codes))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n.astype(np.float64)),
                                              pa.array(n * own), pa.array(n * own * own)], ["lang", "n", "s1", "s2"])

    sums = arrow_map(counts, moments, "lang string, n double, s1 double, s2 double").groupBy("lang").agg(
        F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).collect()
    for r in sums:
        mean = r.s1 / r.n
        model.limits[r.lang] = (mean, max(0.0, r.s2 / r.n - mean * mean) ** 0.5)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", evidence: float = 30.0, slack: float = 1.5,
             deviations: float = 4.0) -> DataFrame:
    """(row, lang_pred, score, bits, accepted): every column of ``docs`` in ``row``.

    ``score`` is the softmax over the languages of the log-likelihood of at
    most ``evidence`` symbols at the text's mean rate. A text is accepted if
    its bits per symbol are at most the language's training mean plus ``slack``
    plus ``deviations`` standard errors of a text of its length. A text that is
    null, empty or has no letter is ``und`` with score 0, not accepted; so is
    every text if nothing was learned. Equal cross-entropies go to the first
    language in alphabetical order. Texts are read whole, in pieces, so a very
    long one takes little more memory than itself.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        known = len(model.languages)
        mean = np.array([model.limits.get(x, (0, 0))[0] for x in model.languages])
        deviation = np.array([model.limits.get(x, (0, 0))[1] for x in model.languages])
        for batch in batches:
            texts = batch.num_rows
            total, length = np.zeros((max(1, known), texts)), np.zeros(texts, np.int64)
            for a, b, codes, at in text_codes(pc.struct_field(batch.column(0), text_col)):
                counts = np.diff(at)
                length[a:b] += counts
                full = np.flatnonzero(counts)
                if len(full) and known:
                    kinds, where = np.unique(codes, return_inverse=True)
                    for i, bits in enumerate(model.bits(kinds)):
                        total[i, a + full] += np.add.reduceat(bits[where], at[:-1][full])
            entropy = np.where((length > 0) & (known > 0), total / np.maximum(length, 1), np.inf)
            best = np.argmin(entropy, axis=0)
            bits = entropy[best, np.arange(texts)]
            found = (length > 0) & (known > 0)
            with np.errstate(invalid="ignore", over="ignore"):
                apart = np.where(found, entropy - bits, 0.0) * np.minimum(length, evidence) * np.log(2)
                score = np.where(found, 1.0 / np.exp(-apart).sum(axis=0), 0.0)
            names = np.array([*model.languages, "und"], dtype=object)[np.where(found, best, known)]
            accepted = np.zeros(texts, bool)
            if known:
                limit = mean[best] + slack + deviations * deviation[best] / np.sqrt(np.maximum(length, 1))
                accepted = found & (bits <= limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(np.where(found, bits, 0.0)),
                 pa.array(accepted)], ["row", "lang_pred", "score", "bits", "accepted"])

    whole = whole_rows(docs)
    return arrow_map(whole, rows, with_fields(
        whole, lang_pred="string", score="double", bits="double", accepted="boolean"))


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(id_col.cast("string")) % parts


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      parts: int = 4, held_out: int = 2, **options) -> DataFrame:
    """Learn from the labelled rows outside the fold, predict every row; adds ``held_out`` to what ``identify`` gives.

    A row with a null id is in no fold: not learned from, not held out.
    """
    model = train(docs.where(fold(F.col(id_col), parts) != held_out), text_col, lang_col)
    out = identify(docs, model, text_col, **options)
    return out.withColumn("held_out", F.coalesce(fold(F.col(f"row.`{id_col}`"), parts) == held_out, F.lit(False)))
