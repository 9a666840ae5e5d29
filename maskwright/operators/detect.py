"""Candidate extraction and gating.

The whole scan of a text is one column expression: no join, no shuffle, no
Python on the data path. Text that cannot hold a shape never reaches its regex.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from ..functions.arrays import empty, let
from ..functions.matching import chunked, find_all, gaps, place, placed_once, slice_of
from ..functions.rx import alternatives, grouped, java, strip_boundaries
from ..functions.validators import VALIDATORS, secret_value_ok
from . import suppress

CANDIDATE = "struct<start:int,end:int,rank:int,text:string>"
GATED = "struct<start:int,end:int,rank:int,text:string,reason:string>"
_FOUND = "struct<rank:int,hits:array<string>,pieces:array<string>>"

# Order of claims: stage 1, identifiers, stage 2, generic numbers. Emails take no part.
EMAIL_RANK = 0
_extra: list[V.Detector] = []


def register_detector(detector: V.Detector) -> None:
    """Add a detector row; stage 1 and 2 rows run after the built-in ones of that stage."""
    if detector.stage not in (1, 2):
        raise ValueError("a detector belongs to stage 1 or 2")
    if any(d.id == detector.id for d in catalogue()):
        raise ValueError(f"detector {detector.id} exists")
    _extra.append(detector)


def unregister_detector(detector_id: str) -> None:
    _extra[:] = [d for d in _extra if d.id != detector_id]


def catalogue() -> list[V.Detector]:
    """Every detector in claim order; the position in the list is its rank."""
    return [
        V.Detector("email", V.EMAIL, 0, contains=("@",), dispositive=True),
        *V.STAGE1, *(d for d in _extra if d.stage == 1),
        V.Detector("secret_token", V.SECRET_TOKEN, 10, dispositive=True),
        # Some run of value characters must be long enough and hold more than letters.
        V.Detector("keyword_value", V.KEYWORD_VALUE, 11,
                   gate=r"(?<![A-Za-z0-9._\-])(?=[A-Za-z]*[0-9._\-])[A-Za-z0-9._\-]{12}",
                   dispositive=True),
        *V.STAGE2, *(d for d in _extra if d.stage == 2),
        V.Detector("numeric_generic", V.NUMERIC, 3, dispositive=True),
    ]


def ranks() -> dict[str, int]:
    return {d.id: i for i, d in enumerate(catalogue())}


def compiled(d: V.Detector) -> str:
    """The detector's pattern for the JVM."""
    if d.id == "numeric_generic":
        # Every alternative starts with one of these; looking first saves seven attempts.
        return java(r"(?=[$€£¥₹₩₿₺₨₱฿+(\d])(?:" + d.pattern + ")")
    if d.id == "keyword_value":
        # A keyword starts with a letter, so the leading boundary is a look behind.
        return ("(?i)(?-i:(?<![A-Za-z0-9_]))" + java(grouped(V.KEYWORDS_LONGEST_FIRST))
                + java(V.KEYWORD_VALUE_TAIL))
    return java(d.pattern)


def in_countries(country: Column, codes) -> Column:
    return F.coalesce(country.isin(*codes), F.lit(False)) if codes else F.lit(False)


def contains_any(text: Column, words) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


class Screen:
    """What the gates of a text look at: the text, its outline and its words in lower case.

    The outline has 0 for every digit and A for every capital, so that a shape
    is a plain string to look for. Both are read by many gates and made once.
    """

    _DIGITS, _CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def __init__(self, text: Column, outline: Column | None = None, lower: Column | None = None):
        self.text = text
        self.outline = Screen.outlined(text) if outline is None else outline
        self.lower = F.lower(text) if lower is None else lower

    @staticmethod
    def outlined(text: Column) -> Column:
        return F.translate(text, Screen._DIGITS + Screen._CAPITALS,
                           "0" * len(Screen._DIGITS) + "A" * len(Screen._CAPITALS))

    @staticmethod
    def of(text: Column, body) -> Column:
        """``body(screen)`` with outline and lower case computed once."""
        return let(Screen.outlined(text), lambda o: let(F.lower(text), lambda w: body(Screen(text, o, w))))

    def holds(self, pattern: str) -> Column:
        """Is ``pattern`` found in the text?"""
        plain = outlines(pattern)
        return contains_any(self.outline, plain) if plain else self.text.rlike(java(pattern))

    def near(self, keyword: str) -> Column:
        """Could a match of ``keyword`` be found in some slice of the text?"""
        found = self.text.rlike(java(strip_boundaries(keyword), True))
        heads = word_heads(keyword)
        return contains_any(self.lower, heads) & found if heads else found


def outlines(pattern: str) -> tuple[str, ...]:
    """The plain strings of an outline that are there exactly where ``pattern`` is found, none if there are no such."""
    out = [""]
    for token, many, maybe in re.findall(r"(\\d|\[A-Z\]|\\\.|[ \-|]|.)(?:\{(\d+)\})?(\??)", pattern, re.S):
        sign = {r"\d": "0", "[A-Z]": "A", r"\.": ".", " ": " ", "-": "-", "|": "|"}.get(token)
        if sign is None:
            return ()
        if sign == "|":
            return (*out, *rest) if (rest := outlines(pattern.partition("|")[2])) and not (many or maybe) else ()
        longer = [o + sign * int(many or 1) for o in out]
        out = longer + out if maybe else longer
    return tuple(o for o in out if o)


def word_heads(keyword: str) -> tuple[str, ...]:
    """What the alternatives of a keyword pattern begin with, in lower case; none where that is not plain.

    Only for ASCII patterns: under ``(?i)`` their letters fold to ASCII letters alone.
    """
    inner = re.fullmatch(r"\\b\(\?:(.*)\)\\b", keyword)
    if not inner or not keyword.isascii() or len(alternatives(keyword)) > 1:
        return ()
    heads = [re.match(r"(?:(?:[A-Za-z0-9]|\\\.)(?![?*+{]))*", word)[0] for word in alternatives(inner[1])]
    return tuple(dict.fromkeys(h.replace("\\", "").lower() for h in heads)) if all(heads) else ()


def prescreen(d: V.Detector, screen: Screen, country: Column, context: bool = True) -> Column:
    """Necessary condition for any accepted match of ``d``, checked on the whole text.

    Without ``context`` it is one for any match of the shape.
    """
    text = screen.text
    gate = F.lit(True)
    if d.contains:
        gate = contains_any(text, d.contains)
    if d.id == "secret_token":
        gate = F.lit(False)
        for char, words in V.SECRET_TOKEN_PARTS.items():
            held = contains_any(text, words)
            gate = gate | (text.contains(char) & held if char else held)
    if d.gate:
        gate = screen.holds(d.gate)
    if d.outline:
        gate = contains_any(screen.outline, d.outline) & gate
    if context and d.keyword and not d.dispositive:
        gate = gate & (in_countries(country, d.countries) | screen.near(d.keyword))
    return gate


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def has_digit_or_long_alnum(text: Column) -> Column:
    return text.rlike("[0-9]|[A-Za-z0-9]{8}")


def _found(d: V.Detector, rank: int, screen: Screen, country: Column, context: bool) -> Column:
    """The matches of one detector with the text around them, null where there are none.

    A single match whose text is nowhere else needs no pieces to be placed.
    """
    pattern, text = compiled(d), screen.text

    def found(hits: Column) -> Column:
        return F.when(F.size(hits) > 0, F.struct(
            F.lit(rank).alias("rank"), hits.alias("hits"),
            F.when(~placed_once(text, hits), gaps(text, pattern)).alias("pieces")))
    return F.when(prescreen(d, screen, country, context), let(find_all(text, pattern), found))


def extract(text: Column, country: Column, email, numeric, only=None, context: bool = True) -> Column:
    """Raw matches of every enabled detector, ``array<array<candidate>>`` flattened.

    Without ``context``, shapes that no keyword or country can confirm are kept too.
    """
    email, numeric = (x if isinstance(x, Column) else F.lit(bool(x)) for x in (email, numeric))
    rows = [(i, d) for i, d in enumerate(catalogue()) if only is None or d.id in only]
    digit_rows = [(i, d) for i, d in rows if d.stage in (1, 2, 3)]
    ident_rows = [(i, d) for i, d in rows if d.stage in (10, 11)]
    email_rows = [(i, d) for i, d in rows if d.stage == 0]

    def batch(screen, part, enabled):
        if not part:
            return empty(_FOUND)
        return F.when(enabled, F.array_compact(F.array(*[_found(d, i, screen, country, context) for i, d in part]))) \
            .otherwise(empty(_FOUND))

    def gathered(screen: Screen) -> Column:
        return F.concat(batch(screen, email_rows, email),
                        batch(screen, digit_rows, numeric & screen.outline.contains("0")),
                        batch(screen, ident_rows, numeric))

    def locate(f: Column) -> Column:
        placed = place(f["hits"], f["pieces"], text)

        def whole(h: Column) -> Column:
            return F.struct(h["start"].alias("start"), h["end"].alias("end"),
                            f["rank"].alias("rank"), h["text"].alias("text")).cast(CANDIDATE)

        def value_only(h: Column) -> Column:
            # The same pattern on the match alone finds the same value.
            value = F.regexp_extract(h["text"], keyword_pattern, 1)
            quote = F.when(h["text"].rlike("[\"']\\z"), 1).otherwise(0)
            return F.struct((h["end"] - quote - F.length(value)).alias("start"),
                            (h["end"] - quote).alias("end"),
                            f["rank"].alias("rank"), value.alias("text")).cast(CANDIDATE)

        keyword = next(((i, d) for i, d in rows if d.id == "keyword_value"), None)
        if keyword is None:
            return F.transform(placed, whole)
        keyword_pattern = compiled(keyword[1])
        return F.when(f["rank"] == keyword[0], F.transform(placed, value_only)).otherwise(
            F.transform(placed, whole))

    return F.flatten(F.transform(Screen.of(text, gathered), locate))


def passes(c: Column, country: Column, chunks: Column, rows) -> Column:
    """Checksum first, then shape alone, page country or a keyword close by."""
    checked = None
    for i, d in rows:
        if d.id == "keyword_value":
            ok = secret_value_ok(c["text"])
        elif d.validator:
            ok = VALIDATORS[d.validator](c["text"])
        else:
            continue
        checked = F.when(c["rank"] == i, ok) if checked is None else checked.when(c["rank"] == i, ok)
    if checked is not None:
        sure = [i for i, d in rows if d.id != "keyword_value" and not d.validator]
        checked = F.when(c["rank"].isin(*sure), True).otherwise(checked.otherwise(True)) if sure else checked.otherwise(True)
    else:
        checked = F.lit(True)

    gated = [(i, d) for i, d in rows if not d.dispositive]
    if not gated:
        return checked
    width = F.lit(50)
    for w in sorted({d.window for _, d in gated}):
        members = [i for i, d in gated if d.window == w]
        width = F.when(c["rank"].isin(*members), w).otherwise(width)

    def by_context(near: Column) -> Column:
        chain = None
        for i, d in gated:
            ok = in_countries(country, d.countries)
            if d.keyword:
                ok = ok | near.rlike(java(d.keyword, True))
            chain = F.when(c["rank"] == i, ok) if chain is None else chain.when(c["rank"] == i, ok)
        return chain
    context = F.when(
        c["rank"].isin(*[i for i, _ in gated]),
        let(width, lambda w: let(slice_of(chunks, c["start"] - w, c["end"] + w), by_context)),
    ).otherwise(True)
    return F.when(checked, context).otherwise(False)


def candidates(text: Column, country: Column | None = None, email=True, numeric=True,
               profile: str = "precise", only=None) -> Column:
    """Accepted candidates before overlaps are settled.

    Generic numbers stay in the result when a false-positive rule fires; the
    rule is named in ``reason``.
    """
    country = F.lit(None).cast("string") if country is None else country
    rows = [(i, d) for i, d in enumerate(catalogue()) if only is None or d.id in only]
    generic = next((i for i, d in rows if d.id == "numeric_generic"), -1)

    def judge(c: Column, chunks: Column) -> Column:
        why = F.when(
            c["rank"] == generic,
            suppress.with_around(
                slice_of(chunks, c["start"] - suppress.MARGIN,
                         F.greatest(c["start"] + suppress.MARGIN, c["end"] + suppress.TAIL)),
                c["start"], c["text"], lambda a: suppress.reason(a, profile)))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["rank"].alias("rank"),
                        c["text"].alias("text"), why.alias("reason")).cast(GATED)

    def gate(raw: Column) -> Column:
        return F.when(F.size(raw) > 0, let(chunked(text), lambda chunks: F.transform(
            F.filter(raw, lambda c: passes(c, country, chunks, rows)),
            lambda c: judge(c, chunks),
        ))).otherwise(empty(GATED))
    return let(extract(text, country, email, numeric, only), gate)


def detector_name(rank: Column) -> Column:
    return F.element_at(F.split(F.lit(",".join(d.id for d in catalogue())), ","), rank + 1)


def detectors_table(spark):
    """The catalogue as a table."""
    return spark.createDataFrame(
        [(i, d.id, d.stage, d.action, d.validator, list(d.countries), d.window if d.keyword else None)
         for i, d in enumerate(catalogue())],
        "rank int, detector string, stage int, action string, validator string, "
        "countries array<string>, keyword_window int")
