"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (as bytes, with word borders) and of
itself; its vector is the mean of their embeddings, a passage's vector the mean
of its words. A linear softmax reads the passage. A text is as toxic as its
worst passage, so one insult counts alike in a short and in a long text, and a
misspelling that was never seen still shares most n-grams with what was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, whole_rows, with_fields
from .words import BYTE_LOWER, BYTE_VALUE, U64, mix, pieces, powers, utf8

SIZES = (3, 4, 5)
PIECE = 1 << 20

#: Bytes of words: letters, digits, everything beyond ASCII, and signs that stand in for letters.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True
IN_WORD[[36, 42, 64]] = True


@dataclass(frozen=True)
class Settings:
    """What training depends on. ``toxic_rows``, ``clean_rows`` and ``max_chars`` bound the labelled sample."""

    toxic_rows: int = 2000
    clean_rows: int = 4000
    max_chars: int = 20_000
    buckets: int = 1 << 18
    width: int = 8
    passage: int = 6
    easy_share: float = 0.15
    check_share: float = 0.25
    rounds: int = 8
    smooth: float = 4.0
    lean: float = 3.0
    min_share: float = 0.004
    min_texts: int = 3
    batch: int = 512
    steps: int = 200
    rate: float = 0.3
    decay: float = 1e-3
    seed: int = 7


@dataclass
class Model:
    """The embeddings seen through the softmax: one weight per bucket, and the bias. Buckets not ``kept`` do not count."""

    weights: np.ndarray
    kept: np.ndarray
    bias: float
    settings: Settings
    #: Slope and shift from the worst passage's logit to the text's, fitted on texts the embeddings have not seen.
    slope: float = 1.0
    shift: float = 0.0


@dataclass
class Words:
    """Words of a batch: starts and ends, first word of each text and their number, and their hashes."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    whole: np.ndarray
    #: Per byte and one before and after: the number of its word, 0 outside words.
    run: np.ndarray
    total: np.ndarray
    inverse: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    inside = IN_WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < n]
    begin[borders] = inside[borders]
    run = np.zeros(n + 2, np.int32)
    run[1:n + 1] = np.where(inside, np.cumsum(begin), 0)
    starts, ends = np.flatnonzero(begin), np.flatnonzero(inside & (run[1:n + 1] != run[2:n + 2])) + 1
    p, inverse = powers(n + 3), powers(n + 3, inverse=True)
    total = np.zeros(n + 3, U64)  # before each byte, counted from one before the first
    np.cumsum(np.where(inside, BYTE_VALUE[BYTE_LOWER[data]], U64(0)) * p[1:n + 1], out=total[2:n + 2])
    total[n + 2] = total[n + 1]
    whole = mix((total[ends + 1] - total[starts + 1]) * inverse[starts + 1] + U64(99))
    return Words(starts, ends, np.searchsorted(starts, offsets), whole, run, total, inverse)


def subwords(w: Words, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(byte, bucket)]: n-grams of every size, each with a byte of its word, and the words themselves.

    A window is one byte or border, bytes of one word, one byte or border.
    """
    out, length = [], len(w.run)
    for size in SIZES:
        count = length - size + 1
        if count <= 0:
            continue
        at = np.flatnonzero((w.run[1:1 + count] > 0) & (w.run[1:1 + count] == w.run[size - 2:size - 2 + count]))
        own = w.run[at + 1]
        left, right = w.run[at] == own, w.run[at + size - 1] == own
        lo, hi = at + 1 - left, at + size - 1 + right
        value = (w.total[hi] - w.total[lo]) * w.inverse[lo]
        value = mix(value + (left.astype(U64) * U64(2) + right.astype(U64) + U64(4 * size)) * U64(0x9E3779B97F4A7C15))
        out.append((at, (value % U64(buckets)).astype(np.int64)))
    out.append((w.starts, (w.whole % U64(buckets)).astype(np.int64)))
    return out


def passages(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each passage and their number, first passage of each text and their number)."""
    counts = np.diff(first)
    per = -(-counts // size)
    start = np.concatenate([[0], np.cumsum(per)])
    owner = np.repeat(np.arange(len(counts)), per)
    return np.concatenate([first[:-1][owner] + (np.arange(len(owner)) - start[owner]) * size, first[-1:]]), start


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i + 1]]``; every range is full."""
    return np.add.reduceat(values, at[:-1]) if len(at) > 1 else np.zeros(0)


def score_texts(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """The worst passage's probability per text; 0 for a text without words."""
    texts = len(offsets) - 1
    out = np.zeros(texts)
    w = words_of(data, offsets)
    if len(w.starts) == 0:
        return out
    total, number = np.zeros(len(data), np.float32), np.zeros(len(data), np.float32)
    for at, bucket in subwords(w, model.settings.buckets):
        total[at] += model.weights[bucket]  # a byte stands for one n-gram of a size
        number[at] += model.kept[bucket]
    word = np.append(w.starts, len(data))
    mean = _sums(total.astype(np.float64), word) / np.maximum(1, _sums(number, word))
    at, of_text = passages(w.first, model.settings.passage)
    logit = _sums(mean, at) / np.diff(at) + model.bias
    full = np.flatnonzero(np.diff(of_text) > 0)
    out[full] = np.maximum.reduceat(logit, of_text[:-1][full])
    out[full] = 1 / (1 + np.exp(-np.clip(model.slope * out[full] + model.shift, -30, 30)))
    return out


def _bags(texts: pa.Array, toxic: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(first word of each text and their number, number of each word's bag, bag starts, buckets, buckets that count, lean).

    ``lean`` is each bucket's smoothed log-ratio of its toxic texts to those expected.

    Equal words share one bag: ``ids[bag_at[k]:bag_at[k + 1]]``. N-grams of
    words of few texts are left out: they would only be learned by heart.
    """
    data, offsets = utf8(texts)
    parts = [(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in pieces(offsets, PIECE)]
    whole, counts = [], []
    for part, at in parts:
        w = words_of(part, at)
        whole.append(w.whole)
        counts.append(np.diff(w.first))
    first = np.concatenate([[0], *counts]).cumsum()
    whole = np.concatenate(whole) if whole else np.zeros(0, U64)
    _, kept, same = np.unique(whole, return_index=True, return_inverse=True)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    pairs = np.unique(text_of * np.int64(max(1, len(kept))) + same) % max(1, len(kept))
    held_by = np.bincount(pairs, minlength=len(kept))
    pairs = np.unique((text_of * np.int64(max(1, len(kept))) + same)[toxic[text_of]]) % max(1, len(kept))
    toxic_by = np.bincount(pairs, minlength=len(kept))
    del whole, text_of, pairs
    rank = np.argsort(kept)  # distinct words in the order they first stand
    kept = kept[rank]
    number = np.empty(len(rank), np.int64)
    number[rank] = np.arange(len(rank))
    same, held_by, toxic_by = number[same].astype(np.int32), held_by[rank], toxic_by[rank]
    ids, sizes, before = [], [], 0
    for part, at in parts:
        w = words_of(part, at)
        mine = kept[np.searchsorted(kept, before):np.searchsorted(kept, before + len(w.starts))] - before
        before += len(w.starts)
        if len(mine) == 0:
            continue
        size = w.ends[mine] - w.starts[mine] + 1
        start = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(w.starts[mine] - start[:-1], size) + np.arange(start[-1])
        source[start[1:] - 1] = -1
        once = words_of(np.where(source < 0, 32, part[source]).astype(np.uint8), start[[0, -1]])
        grams = subwords(once, s.buckets)
        position = np.concatenate([g[0] for g in grams])
        order = np.argsort(position, kind="stable")
        ids.append(np.concatenate([g[1] for g in grams]).astype(np.int32)[order])
        sizes.append(np.diff(np.searchsorted(position[order], np.append(once.starts, start[-1]))))
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    bag_at = np.concatenate([[0], *sizes]).cumsum()
    held, bad = (np.bincount(ids, np.repeat(by, np.diff(bag_at)), s.buckets) for by in (held_by, toxic_by))
    base = s.smooth * toxic.mean()
    lean = np.log((bad + base) / (held * toxic.mean() + base))
    enough = held >= max(s.min_texts, s.min_share * len(texts))
    use = enough[ids]
    bag_at = np.concatenate([[0], np.cumsum(use)])[bag_at]
    return first, same, bag_at, ids[use], enough, lean


def fit(texts: pa.Array, toxic: np.ndarray, settings: Settings = Settings()) -> Model:
    """Embeddings and softmax from labelled texts.

    The first round takes every passage of a toxic text as toxic; later ones
    take those the model holds for toxic, and the worst one. With one label
    alone nothing can be learned: every score is that label's share.
    """
    s, rng = settings, np.random.default_rng(settings.seed)
    weights, enough, bias = np.zeros(s.buckets, np.float32), np.zeros(s.buckets, bool), 0.0
    toxic = np.asarray(toxic, bool)
    if len(texts) == 0 or toxic.all() or not toxic.any():
        return Model(weights, enough, 6.0 if len(texts) and toxic.all() else -6.0, s)
    seen = rng.random(len(texts)) >= s.check_share
    first, same, bag_at, ids, enough, lean = _bags(texts, toxic & seen, s)
    if len(same) == 0:
        return Model(weights, enough, -6.0, s)
    p_at, of_text = passages(first, s.passage)
    text_of = np.repeat(np.arange(len(texts)), np.diff(of_text))
    table = rng.normal(0, 0.1, (s.buckets, s.width)).astype(np.float32)
    soft = rng.normal(0, 0.3, (s.width, 2)).astype(np.float32)
    table[:, 0], soft[0] = lean, (-s.lean, s.lean)  # where training starts: what counts alone tell
    base = np.zeros(2, np.float32)
    grown_t, grown_s, grown_b = np.full(s.buckets, 1e-6, np.float32), np.full(soft.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    total = len(text_of)
    target = toxic[text_of].copy()
    used = seen[text_of]
    for turn in range(s.rounds):
        chosen = np.flatnonzero(used)
        rng.shuffle(chosen)
        positive = max(1, int(target[chosen].sum()))
        weight = np.where(target, 0.5 * len(chosen) / positive, 0.5 * len(chosen) / max(1, len(chosen) - positive))
        weight = (np.minimum(weight, 20.0) if turn == 0 else np.ones(total)).astype(np.float32)
        batch = min(s.batch, max(32, len(chosen) // s.steps))
        for k in range(0, len(chosen), batch):
            part = chosen[k:k + batch]
            sizes = p_at[part + 1] - p_at[part]
            w_at = np.concatenate([[0], np.cumsum(sizes)])
            word = same[np.repeat(p_at[part] - w_at[:-1], sizes) + np.arange(w_at[-1])]
            kinds, where = np.unique(word, return_inverse=True)
            n = bag_at[kinds + 1] - bag_at[kinds]
            g_at = np.concatenate([[0], np.cumsum(n)])
            found = ids[np.repeat(bag_at[kinds] - g_at[:-1], n) + np.arange(g_at[-1])]
            some = np.flatnonzero(n > 0)
            vector = np.zeros((len(kinds), s.width), np.float32)
            if len(some):
                vector[some] = np.add.reduceat(table[found], g_at[:-1][some], axis=0) / n[some, None]
            hidden = np.add.reduceat(vector[where], w_at[:-1], axis=0) / sizes[:, None]
            logit = hidden @ soft + base
            logit -= logit.max(axis=1, keepdims=True)
            prob = np.exp(logit)
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(part)), target[part].astype(int)] -= 1
            prob *= (weight[part] / len(part))[:, None]
            d_soft, d_base = hidden.T @ prob, prob.sum(axis=0)
            d_hidden = (prob @ soft.T) / sizes[:, None]
            d_word = np.repeat(d_hidden, sizes, axis=0)
            d_kind = np.stack([np.bincount(where, d_word[:, j], len(kinds)) for j in range(s.width)], axis=1) / np.maximum(n, 1)[:, None]
            slots, back = np.unique(found, return_inverse=True)
            d_gram = np.repeat(d_kind, n, axis=0)
            d_slot = np.stack([np.bincount(back, d_gram[:, j], len(slots)) for j in range(s.width)], axis=1).astype(np.float32)
            d_slot += s.decay / batch * table[slots]
            grown_t[slots] += (d_slot * d_slot).mean(axis=1)
            table[slots] -= s.rate * d_slot / np.sqrt(grown_t[slots])[:, None]
            grown_s += d_soft * d_soft
            soft -= (0.2 * s.rate * d_soft / np.sqrt(grown_s)).astype(np.float32)
            grown_b += d_base * d_base
            base -= (0.2 * s.rate * d_base / np.sqrt(grown_b)).astype(np.float32)
        weights = np.where(enough, table @ (soft[:, 1] - soft[:, 0]), 0).astype(np.float32)
        bias = float(base[1] - base[0])
        # which passages of the toxic texts are it, and which clean ones are not clear yet
        n = np.diff(bag_at)
        word_score, some = np.zeros(len(n)), np.flatnonzero(n > 0)
        if len(some):
            word_score[some] = np.add.reduceat(weights[ids], bag_at[:-1][some]) / n[some]
        logit = np.add.reduceat(word_score[same], p_at[:-1]) / np.diff(p_at) + bias
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text_of, logit)
        target = toxic[text_of] & ((logit > 0) | (logit == worst[text_of]))
        clean = ~toxic[text_of] & ((logit > -2) | (rng.random(total) < s.easy_share))
        used = seen[text_of] & (target | clean)
    held = ~seen & np.isfinite(worst)
    slope, shift = _calibrated(worst[held], toxic[held])
    return Model(weights, enough, bias, s, slope, shift)


def _calibrated(logit: np.ndarray, toxic: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-out texts; as it is where one label is missing."""
    if toxic.all() or not toxic.any():
        return 1.0, 0.0
    y = np.where(toxic, 1 - 1 / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    x, w = np.stack([np.clip(logit, -30, 30), np.ones(len(logit))], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-3 * w
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), grad) * 0.5
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
          settings: Settings = Settings()) -> Model:
    """Fit on at most ``toxic_rows`` and ``clean_rows`` labelled rows, those of the smallest id hashes."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("toxic")).distinct()
    picked = None
    for value, most in ((0, settings.clean_rows), (1, settings.toxic_rows)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("key"), "key").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.where(F.char_length(text_col) <= settings.max_chars).select(
        F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    rows = texts.join(picked, "key").orderBy("key", "text", "toxic").limit(
        2 * (settings.toxic_rows + settings.clean_rows)).toArrow()
    texts = pa.concat_arrays(rows["text"].cast(pa.large_string()).chunks) if rows.num_rows else pa.array([], pa.large_string())
    return fit(texts, rows["toxic"].to_numpy(), settings)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(row, score, predicted): every column of ``docs`` in ``row``; a null or empty text scores 0."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(pc.struct_field(batch.column(0), text_col))
            made = [score_texts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], spread.value)
                    for a, b in pieces(offsets, PIECE)]
            scores = np.concatenate(made) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                                             ["row", "score", "predicted"])

    whole = whole_rows(docs)
    return arrow_map(whole, rows, with_fields(whole, score="double", predicted="int"))


def score_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", parts: int = 3, held_out: int = 1, threshold: float = 0.7,
                   settings: Settings = Settings()) -> DataFrame:
    """Learn from labelled rows outside the fold, score every row; adds ``held_out``.

    A row with a null id is in no fold: not learned from, not held out. Labels
    other than 0 and 1 are not learned from. With no usable label, or one label
    only, every text with words scores near 0, or near 1 if all are toxic.
    """
    from .language_id import fold
    train = labels.where(fold(F.col(id_col), parts) != held_out)
    out = score(docs, learn(docs, train, id_col, text_col, label_col, settings), text_col, threshold)
    return out.withColumn("held_out", F.coalesce(fold(F.col(f"row.`{id_col}`"), parts) == held_out, F.lit(False)))
