"""Quality by weak supervision: rules vote or abstain, their accuracies are learned, a posterior decides.

Every rule looks at a few numbers of a text and votes good, bad or not at all.
No labels are read: expectation-maximisation over the counts of vote patterns
estimates, for texts of either kind, how often each rule's vote is right, and
the share of good texts. A text is kept by its posterior probability of being
good, not by passing every rule. All work is DataFrame and SQL functions; the
patterns are at most ``3 ** rules`` rows whatever the data, and a round of the
estimation is one aggregate over them.

A null text is an empty one: no words, so the base rules fail it. Rows that
repeat an id are judged each. A text is read whole, in one row: its words and
their hashes take some 100 bytes a word while it is measured. The texts are
not carried along; all other columns are, in ``row``, so names do not clash.
An empty table gives an empty result. Texts with equal votes have equal
posteriors; one of exactly the threshold is kept.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import let, with_once

from .shared import BLANK_CHARS, BLANKS, stored

#: Words of a window that counts as repeated where it comes twice.
WINDOW = 8


def without(text: Column, characters: str) -> Column:
    """``text`` without some ASCII characters."""
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def repeated_words(words: Column, n: Column) -> Column:
    """How many of ``n`` words lie in a window of eight that occurs twice or more, overlaps included.

    The hash of a window is made of its halves', three times over. Positions
    are sorted by hash only in texts that have equal windows.
    """
    def joined(hashes: Column, width: int, count: Column) -> Column:
        return F.zip_with(F.slice(hashes, F.lit(1), count), F.slice(hashes, F.lit(1 + width), count), lambda a, b: F.xxhash64(a, b))

    def positions(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column, e: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"] == e["h"], F.get(s, k + 1)["h"] == e["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: again(s, e, k)), lambda e: e["i"])))

    def covered(at: Column) -> Column:
        rest = F.size(at) - 1
        apart = F.zip_with(F.slice(at, F.lit(1), rest), F.slice(at, F.lit(2), rest), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(apart, F.lit(WINDOW), lambda total, step: total + step)

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(positions(windows), covered)).otherwise(F.lit(0))

    ones = F.transform(words, lambda w: F.xxhash64(w))
    found = let(ones, lambda h: let(joined(h, 1, n - 1), lambda two: let(
        joined(two, 2, n - 3), lambda four: let(joined(four, 4, n - 7), of_windows))))
    return F.when(n > WINDOW, found).otherwise(F.lit(0))


def signals(text: Column) -> Column:
    """What the rules look at, as a struct of longs."""
    def gone(characters: str) -> Column:
        return F.char_length(text) - F.char_length(without(text, characters))

    def of_words(words: Column) -> Column:
        n = F.when(F.element_at(words, 1) == "", F.lit(0)).otherwise(F.size(words))
        return F.struct(n.alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"),
                        repeated_words(words, n).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    words = let(F.split(F.btrim(text, F.lit(BLANK_CHARS)), BLANKS + "+", -1), of_words)
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != ""), of_lines)

    def laid_out(w: Column, x: Column) -> Column:
        columns = {
            "n_words": w["n_words"], "word_chars": F.char_length(without(text, BLANK_CHARS)), "n_symbols": gone("#*$%&|<>"),
            "n_dup_lines": x["n_dup_lines"], "n_repeat_words": w["n_repeat_words"], "n_lines": x["n_lines"], "n_distinct": w["n_distinct"],
            "n_letters": F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")),
            "n_odd": F.char_length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\s.,;:!?'\"()\-]+", "")),
            "n_capitals": F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), "n_calls": gone("!?"), "n_stops": gone(".!?")}
        return F.struct(*[c.cast("long").alias(name) for name, c in columns.items()])

    return let(words, lambda w: let(lines, lambda x: laid_out(w, x)))


@dataclass(frozen=True)
class Rule:
    """Votes good or bad by conditions on the signals; where neither holds, it abstains."""

    name: str
    good: str
    bad: str


#: The rules with which texts are judged unless others are given. Shares are written without division.
RULES = (
    Rule("length", "n_words BETWEEN 50 AND 100000", "n_words < 30"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "2 * word_chars < 5 * n_words OR word_chars > 20 * n_words"),
    Rule("letters", "100 * n_letters >= 80 * word_chars", "100 * n_letters < 70 * word_chars"),
    Rule("plain", "100 * n_odd <= word_chars", "100 * n_odd > 5 * word_chars"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("capitals", "100 * n_capitals <= 20 * n_letters", "100 * n_capitals > 40 * n_letters"),
    Rule("calls", "10 * n_calls <= n_words", "10 * n_calls > 3 * n_words"),
    Rule("repeats", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("lines", "n_lines >= 3 AND 10 * n_dup_lines <= n_lines", "n_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("variety", "100 * n_distinct >= 25 * n_words OR n_distinct >= 300", "100 * n_distinct < 10 * n_words AND n_distinct < 150"),
    Rule("sentences", "60 * n_stops >= n_words AND 3 * n_stops <= n_words", "n_stops = 0 AND n_words >= 100"),
)


@dataclass(frozen=True)
class Belief:
    """The share of good texts, and how often each rule's vote is right on good and on bad ones."""

    share: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    @staticmethod
    def start(rules: int, share: float = 0.8, on_good: float = 0.95, on_bad: float = 0.6) -> Belief:
        return Belief(share, (on_good,) * rules, (on_bad,) * rules)

    def posterior(self, votes: list[str]) -> Column:
        """The probability of being good, by columns of votes 1, -1 and 0."""
        odds = [repr(log(self.share / (1 - self.share))) + "D"]
        for vote, g, b in zip(votes, self.right_on_good, self.right_on_bad):
            odds.append(f"CASE `{vote}` WHEN 1 THEN {log(g / (1 - b))!r}D WHEN -1 THEN {log((1 - g) / b)!r}D ELSE 0D END")
        return F.expr(f"1 / (1 + exp(-({' + '.join(odds)})))")

    def far_from(self, other: Belief) -> float:
        mine, theirs = ((x.share, *x.right_on_good, *x.right_on_bad) for x in (self, other))
        return max(abs(a - b) for a, b in zip(mine, theirs))


def vote_columns(rules: tuple[Rule, ...]) -> list[str]:
    return [f"vote_{r.name}" for r in rules]


def learned(patterns: DataFrame, rules: tuple[Rule, ...], settled: float = 1e-4, rounds: int = 200, prior: float = 0.02,
            prior_on_good: float = 0.98, prior_on_bad: float = 0.6) -> Belief:
    """Expectation-maximisation over (votes, n) until no estimate moves by more than ``settled``.

    Before they see a vote, rules are taken to be right at the prior rates, with
    a weight of ``prior`` of all their votes, so that neither kind can take the
    other's place and sizes of tables do not matter. Warns if ``rounds`` do not
    suffice.
    """
    votes = vote_columns(rules)
    now = Belief.start(len(rules), on_good=prior_on_good, on_bad=prior_on_bad)
    for _ in range(rounds):
        sums = ["sum(n) AS n", "sum(n * q) AS good"]
        for k, v in enumerate(votes):
            for name, value in (("yes", 1), ("no", -1)):
                sums += [f"sum(IF(`{v}` = {value}, n, 0)) AS {name}{k}", f"sum(IF(`{v}` = {value}, n * q, 0D)) AS good_{name}{k}"]
        r = patterns.withColumn("q", now.posterior(votes)).agg(*map(F.expr, sums)).first()
        if not r.n:
            return now

        def rate(right: float, wrong: float, expected: float, weight: float) -> float:
            return (right + expected * weight) / (right + wrong + weight) if right + wrong + weight > 0 else expected

        on_good, on_bad = [], []
        for k in range(len(votes)):
            yes, no, good_yes, good_no = (r[f"{x}{k}"] for x in ("yes", "no", "good_yes", "good_no"))
            weight = prior * (yes + no)
            on_good.append(rate(good_yes, good_no, prior_on_good, weight))
            on_bad.append(rate(no - good_no, yes - good_yes, prior_on_bad, weight))
        share = (r.good + prior * r.n * 0.5) / (r.n * (1 + prior))
        new = Belief(share, tuple(on_good), tuple(on_bad))
        moved, now = new.far_from(now), new
        if moved <= settled:
            return now
    warnings.warn(f"rule accuracies still moved after {rounds} rounds", stacklevel=2)
    return now


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """(row, signals, vote_..., posterior, base_failed, kept): every column of ``docs`` but the text in ``row``.

    A text of under 20 words, or with more than 30 % of its words in repeated
    windows, fails the base rules and is not kept whatever its posterior.
    Accuracies are learned from all texts that have a word.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    row = F.struct(*others) if others else F.lit(None).cast("struct<>")
    found = with_once(docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), found=signals(F.col("text")))
    found = found.select("row", "found.*")
    cast = [F.when(F.expr(r.good), F.lit(1)).when(F.expr(r.bad), F.lit(-1)).otherwise(F.lit(0)).cast("byte").alias(v)
            for r, v in zip(rules, vote_columns(rules))]
    found = stored(found.select("*", *cast), "votes")
    votes = vote_columns(rules)
    patterns = stored(found.where("n_words > 0").groupBy(*votes).agg(F.count("*").alias("n")), "patterns")
    belief = learned(patterns, rules)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = found.withColumn("posterior", belief.posterior(votes)).withColumn("base_failed", base)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
