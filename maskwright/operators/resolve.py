"""Overlap resolution.

Candidates claim their range in catalogue order; whoever overlaps an earlier
claim is dropped. The survivors are merged left to right, longer first. Only
candidates that touch each other can influence one another, so the text is cut
into islands of touching candidates and each island is settled on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import empty, let, scan_fold, with_once
from . import detect

SETTLED = "struct<start:int,end:int,rank:int,text:string,reason:string,outcome:string>"
RANGE = "struct<start:int,end:int>"
MATCH = "struct<start:int,end:int,type:string,detector:string,text:string>"


def _sorted(items: Column, *keys) -> Column:
    """Sorted by ``keys``, equal ones as they came; by values, as a comparison in lambdas is far slower."""
    keyed = F.transform(items, lambda c, i: F.struct(
        *[key(c).alias(f"k{n}") for n, key in enumerate(keys)], i.alias("i"), c.alias("c")))
    return F.transform(F.sort_array(keyed), lambda k: k["c"])


def _start(c):
    return c["start"]


def _length_first(c):
    return -c["end"]


def _rank(c):
    return c["rank"]


def islands(cands: Column) -> Column:
    """Group candidates (any order) into runs that overlap: ``array<array<..>>``."""
    def ordered(items: Column) -> Column:
        return _sorted(items, _start, _length_first, _rank)

    def group(items: Column) -> Column:
        marked = scan_fold(
            items, F.lit(-1),
            lambda reach, c: F.greatest(reach, c["end"]),
            lambda reach, c: c["start"] >= reach,
            "boolean", brief=True)

        def cut(flags: Column) -> Column:
            heads = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
            return F.transform(heads, lambda h, k: F.slice(
                items, h + 1, F.coalesce(F.get(heads, k + 1), F.size(items)) - h))
        return let(marked, cut)
    return let(cands, lambda c: F.when(F.size(c) == 1, F.array(c)).when(F.size(c) > 0, let(ordered(c), group)).otherwise(
        empty(f"array<{detect.GATED}>")))


def _outcome(c: Column, overlapped: Column, generic: int, silent) -> Column:
    return (
        F.when((c["rank"] != detect.EMAIL_RANK) & overlapped, "overlapped")
        .when(c["rank"].isin(*silent) if silent else F.lit(False), "claimed")
        .when(c["reason"].isNotNull() & (c["rank"] == generic), "suppressed")
        .otherwise("emitted")
    )


def _settle(island: Column) -> Column:
    rows = detect.catalogue()
    generic = len(rows) - 1
    silent = [i for i, d in enumerate(rows) if d.action == "claim"]

    def step(taken: Column, c: Column) -> Column:
        claims = (c["rank"] > detect.EMAIL_RANK) & (c["rank"] < generic) & ~_hits(taken, c)
        return F.when(claims, F.concat(taken, F.array(
            F.struct(c["start"].alias("start"), c["end"].alias("end"))))).otherwise(taken)

    def _hits(taken: Column, c: Column) -> Column:
        return F.exists(taken, lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"]))

    def mark(overlapped, c):
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["rank"].alias("rank"),
            c["text"].alias("text"), c["reason"].alias("reason"),
            _outcome(c, overlapped, generic, silent).alias("outcome")).cast(SETTLED)

    def claim(items: Column) -> Column:
        return scan_fold(_sorted(items, _rank, _start), empty(RANGE), step,
                         lambda taken, c: mark(_hits(taken, c), c), SETTLED, brief=True)

    def merge(items: Column) -> Column:
        def merged(reach, c):
            outcome = F.when((c["outcome"] == "emitted") & (c["start"] < reach), "merged").otherwise(c["outcome"])
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["rank"].alias("rank"), c["text"].alias("text"),
                            c["reason"].alias("reason"), outcome.alias("outcome")).cast(SETTLED)
        return scan_fold(
            _sorted(items, _start, _length_first, _rank), F.lit(-1),
            lambda reach, c: F.when((c["outcome"] == "emitted") & (c["start"] >= reach),
                                    c["end"]).otherwise(reach),
            merged, SETTLED, brief=True)

    return F.when(F.size(island) == 1, F.transform(island, lambda c: mark(F.lit(False), c))) \
        .otherwise(let(claim(island), merge))


def settle(cands: Column) -> Column:
    """Candidates with their ``outcome``: emitted, claimed, overlapped, suppressed, merged."""
    return F.flatten(F.transform(islands(cands), _settle))


def matches(settled: Column) -> Column:
    """The emitted findings, sorted and disjoint."""
    return F.transform(
        F.filter(settled, lambda c: c["outcome"] == "emitted"),
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"),
            F.when(c["rank"] == detect.EMAIL_RANK, "email").otherwise("numeric").alias("type"),
            detect.detector_name(c["rank"]).alias("detector"), c["text"].alias("text")).cast(MATCH))


def scannable(text: Column, email, numeric) -> Column:
    """Cheap test whether a text unit can hold anything of the enabled types."""
    email, numeric = (x if isinstance(x, Column) else F.lit(bool(x)) for x in (email, numeric))
    return (F.length(text) >= 4) & (email | numeric) & (
        email | detect.has_digit(text) | (numeric & detect.has_digit_or_long_alnum(text)))


def _explain(text, country, email, numeric, profile) -> Column:
    text, country, email, numeric = (
        F.col(x) if isinstance(x, str) else x for x in (text, country, email, numeric))
    return F.when(
        scannable(text, email, numeric),
        settle(detect.candidates(text, country, email, numeric, profile)),
    ).otherwise(empty(SETTLED))


# Building the expression means thousands of small calls into the JVM, so an
# expression over named columns is kept and used again.
_built: dict[tuple, Column] = {}


def _keep(kind: str, make, *args) -> Column:
    if any(isinstance(a, Column) for a in args):
        return make()
    key = (kind, *args, tuple(detect.catalogue()))
    if key not in _built:
        _built[key] = make()
    return _built[key]


def explain(text: Column | str, country: Column | str | None = None, email=True, numeric=True,
            profile: str = "precise") -> Column:
    """Every accepted candidate of a text unit with its outcome and reason.

    ``email`` and ``numeric`` are booleans, boolean columns or names of such.
    """
    return _keep("explain", lambda: _explain(text, country, email, numeric, profile),
                 text, country, email, numeric, profile)


def scan(text: Column | str, country: Column | str | None = None, email=True, numeric=True,
         profile: str = "precise") -> Column:
    """Findings of a text unit as ``array<struct<start,end,type,detector,text>>``."""
    return _keep("scan", lambda: matches(explain(text, country, email, numeric, profile)),
                 text, country, email, numeric, profile)


def with_matches(df: DataFrame, text: str = "text", country: str | None = "country", email=True,
                 numeric=True, profile: str = "precise", name: str = "m") -> DataFrame:
    """Add the findings of a text column, scanned once per row whatever is built on them."""
    return with_once(df, **{name: scan(text, country, email, numeric, profile)})
