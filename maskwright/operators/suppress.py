"""False-positive rules for generic numbers.

Each rule looks at the match and at a slice of the text around it. Rules are
ordered from cheap to expensive and :func:`reason` names the first that fires.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from ..functions.arrays import let
from ..functions.rx import finds, java, strip_boundaries

MARGIN = 150
TAIL = 60


@dataclass
class Around:
    """A match with the text near it; ``at`` is the match start inside ``near``.

    ``worded``, if known, is false where ``near`` holds no word of :data:`WORDED`.
    """

    hit: Column
    near: Column
    at: Column
    worded: Column | None = None

    def cut(self, lo, hi) -> Column:
        low = F.greatest(lo if isinstance(lo, Column) else F.lit(lo), F.lit(0))
        return F.substring(self.near, low + 1, F.greatest(hi - low, F.lit(0)))

    @property
    def end(self) -> Column:
        return self.at + F.length(self.hit)

    def before(self, n: int) -> Column:
        return self.cut(self.at - n, self.at)

    def after(self, n: int) -> Column:
        return self.cut(self.end, self.end + n)

    def span(self, n: int) -> Column:
        """``n`` characters either side of the match *start*."""
        return self.cut(self.at - n, self.at + n)


# Found wherever one of these rules finds a word, and in one pass; the two letters fold to s and k.
WORDED = finds("|".join(strip_boundaries(p) for p in (
    V.ORDINAL_PRECURSOR.removeprefix("(?:").partition(")[")[0], V.DATE_KEYWORD.removeprefix(r"\b(?:").removesuffix(r")\b"),
    V.ORDER_REF.removeprefix(r"\b(?:").removesuffix(r")\b"), V.PUBLIC_PRICE, V.COUNT_NOISE, "\u017f", "\u212a")))


def _worded(a: Around, found: Column) -> Column:
    return found if a.worded is None else a.worded & found


def _full(p: str) -> str:
    return java(p).replace("^", r"\A", 1)


_YEAR = "(?:1[0-9]{3}|20[0-9]{2})"


def is_year(a: Around) -> Column:
    return a.hit.rlike(rf"\A{_YEAR}\z")


def is_version(a: Around) -> Column:
    return a.before(1).isin("v", "V") | a.after(2).rlike(r"\A\.[0-9]")


def is_hex_color(a: Around) -> Column:
    return (a.before(1) == "#") & a.hit.rlike(r"\A(?:[0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})\z")


def is_year_range(a: Around) -> Column:
    return a.hit.rlike(rf"\A{_YEAR}[ \-–—]{_YEAR}\z")


def is_percentage(a: Around) -> Column:
    return a.after(1) == "%"


def is_scientific(a: Around) -> Column:
    return a.after(4).rlike(r"\A[eE][+-]?[0-9]")


def is_measurement(a: Around) -> Column:
    return a.after(10).rlike(java(V.UNIT_TRAIL, True))


def is_resolution(a: Around) -> Column:
    return a.cut(a.at - 6, a.end + 8).rlike(java(V.RESOLUTION))


def is_ordinal_label(a: Around) -> Column:
    return _worded(a, a.before(30).rlike(java(V.ORDINAL_PRECURSOR, True)))


def is_date_like(a: Around) -> Column:
    shaped = a.hit.rlike("|".join(f"(?:{_full(p)})" for p in V.DATE_SHAPES))
    compact = a.hit.rlike(r"\A[0-9]{4}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])\z")
    dated = (
        (F.length(a.hit) <= 10)
        & a.hit.rlike(_full(V.DATE_SHAPE_FOR_KEYWORD))
        & _worded(a, a.cut(a.at - 50, a.end + 50).rlike(java(V.DATE_KEYWORD, True)))
    )
    return shaped | compact | dated


def is_order_ref(a: Around) -> Column:
    return _worded(a, a.span(50).rlike(java(V.ORDER_REF, True)))


def is_statistic(a: Around) -> Column:
    return a.span(30).rlike(java(V.STATISTIC, True))


def is_public_price(a: Around) -> Column:
    return _worded(a, a.span(100).rlike(finds(V.PUBLIC_PRICE)))


def is_count_noise(a: Around) -> Column:
    return _worded(a, a.span(150).rlike(finds(V.COUNT_NOISE)))


TIERS = (
    ("structural", (is_year, is_version, is_hex_color, is_year_range, is_percentage, is_scientific)),
    ("trailing", (is_measurement, is_resolution)),
    ("preceding", (is_ordinal_label,)),
    ("keyword_50", (is_date_like, is_order_ref, is_statistic)),
    ("keyword_large", (is_public_price, is_count_noise)),
)
PROFILES = {
    "precise": tuple(rule for _, rules in TIERS for rule in rules),
    "aggressive": (is_version,),
}


def checks(around: Around) -> dict[str, Column]:
    """Every rule on its own, in tier order."""
    return {rule.__name__: rule(around) for rule in PROFILES["precise"]}


def reason(around: Around, profile: str = "precise") -> Column:
    """Name of the first rule that fires, null when none does."""
    picked = None
    for rule in PROFILES[profile]:
        fired = rule(around)
        picked = F.when(fired, rule.__name__) if picked is None else picked.when(fired, rule.__name__)
    return picked


def with_around(near: Column, start: Column, hit: Column, body) -> Column:
    """Bind the slice ``near`` (which begins MARGIN before the match, or at 0)."""
    return let(near, lambda n: let(n.rlike(WORDED), lambda w: body(Around(hit, n, F.least(start, F.lit(MARGIN)), w))))
