"""Country of a page from its metadata, language, host and currency signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from ..functions.arrays import let
from ..functions.rx import java


def country_lang(lang: Column) -> Column:
    """Region subtag of a language tag; a bare language says nothing."""
    region = F.regexp_extract(lang, java(V.LANG_REGION).replace("^", r"\A", 1), 1)
    return let(region, lambda r: F.when(r != "", F.upper(r)))


def country_meta(metas: Column) -> Column:
    """First meta tag, in document order, that names a country."""
    def one(m: Column) -> Column:
        named = F.upper(F.trim(m["content"]))
        direct = F.when(F.lower(m["name"]).isin("geo.country", "country")
                        & named.rlike(r"\A[A-Z]{2}\z"), named)
        localised = (F.lower(m["name"]) == "content-language") \
            | (F.lower(m["http_equiv"]) == "content-language") \
            | (F.lower(m["property"]) == "og:locale")
        return F.coalesce(direct, F.when(localised, country_lang(m["content"])))
    return F.get(F.filter(F.transform(metas, one), lambda c: c.isNotNull()), F.lit(0))


def country_tld(host: Column) -> Column:
    labels = F.split(F.lower(host), r"\.")
    table = F.str_to_map(F.lit(",".join(f"{tld}:{code}" for tld, code in V.TLD_COUNTRY.items())))
    return F.when(F.size(labels) >= 2, F.try_element_at(table, F.element_at(labels, -1)))


def country_currency(sample: Column) -> Column:
    """Three or more of one single-country sign; strictly most wins, then table order."""
    def pick(counts: Column) -> Column:
        picked = None
        for i, (_, country) in enumerate(V.CURRENCY_COUNTRY):
            hit = (counts[i] == F.array_max(counts)) & (counts[i] > 2)
            picked = F.when(hit, country) if picked is None else picked.when(hit, country)
        return picked

    def count(text: Column) -> Column:
        return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
                         for sign, _ in V.CURRENCY_COUNTRY])
    return let(let(sample, count), pick)


def page_country(metas: Column, lang: Column, host: Column, sample: Column) -> Column:
    return F.coalesce(country_meta(metas), country_lang(lang), country_tld(host),
                      country_currency(sample))
