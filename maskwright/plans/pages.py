"""Queries over web pages: tokens, text nodes, country, page scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..functions import url as U
from ..functions.arrays import let, marked, marks, with_once
from ..operators import country, elements, html, mask, resolve
from ..sources import tables
from ..sources.rich_pages import rich_pages
from .registry import query

c = F.col


def pages(spark, sf_dir, rich=True):
    raw = rich_pages(spark, sf_dir) if rich else tables.read(spark, sf_dir, "pages")
    return tables.spread(raw)


def parsed(spark, sf_dir, rich=True):
    return with_once(pages(spark, sf_dir, rich), nodes=html.tree(c("html")))


@query("page_nodes")
def page_nodes(spark, sf_dir):
    """Tokens of every page; joined in order they give the page back."""
    return pages(spark, sf_dir, rich=False).select(
        "page_id", F.inline(html.page_nodes(c("html")))).select("page_id", "pos", "kind", "tag", "token")


@query("page_tokens_complete")
def page_tokens_complete(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", (F.array_join(html.tokens(c("html")), "") == c("html")).alias("complete"))


@query("element_parent")
def element_parent(spark, sf_dir):
    """Parent and depth of every element."""
    return parsed(spark, sf_dir).select("page_id", F.inline("nodes")).where(
        c("kind").isin("open", "void", "raw")).select(
        "page_id", "pos", "tag", "parent", F.size("ancestors").alias("depth"))


@query("page_text_nodes")
def page_text_nodes(spark, sf_dir):
    """Text a scan may look at, outside code, scripts and editors."""
    return parsed(spark, sf_dir).select("page_id", F.inline(html.text_nodes(c("nodes")))).select(
        "page_id", "pos", "parent", "text")


@query("code_pre_skip")
def code_pre_skip(spark, sf_dir):
    """Which preformatted blocks count as code."""
    def blocks(ns):
        return let(marks(html.skip_roots(ns), F.size(ns)), lambda roots: F.transform(
            F.filter(ns, lambda n: (n["kind"] == "open") & (n["tag"] == "pre")),
            lambda n: F.struct(n["pos"].alias("pos"), marked(roots, n["pos"]).alias("skipped"))))
    return parsed(spark, sf_dir).select("page_id", F.inline(let(c("nodes"), blocks)))


@query("preceding_text")
def preceding_text(spark, sf_dir):
    """Text just before a node that holds only a short number."""
    return parsed(spark, sf_dir).select("page_id", F.inline(html.text_nodes(c("nodes")))).where(
        c("preceding").isNotNull()).select("page_id", "pos", "text", "preceding")


@query("metas")
def metas(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.posexplode(html.metas(c("html"))).alias("ord", "m")) \
        .select("page_id", "ord", "m.*")


def _signals(spark, sf_dir):
    cut = with_once(pages(spark, sf_dir), ts=html.tokens(c("html")))
    return cut.select(
        "page_id", html.metas(c("html"), c("ts")).alias("metas"), html.html_lang(c("html"), c("ts")).alias("lang"),
        U.url_parts(c("url"))["host"].alias("host"), html.body_sample(c("html"), c("ts")).alias("sample"))


@query("country_meta")
def country_meta(spark, sf_dir):
    return _signals(spark, sf_dir).select("page_id", country.country_meta(c("metas")).alias("country"))


@query("country_lang")
def country_lang(spark, sf_dir):
    return _signals(spark, sf_dir).select("page_id", "lang", country.country_lang(c("lang")).alias("country"))


@query("country_tld")
def country_tld(spark, sf_dir):
    return _signals(spark, sf_dir).select("page_id", "host", country.country_tld(c("host")).alias("country"))


@query("country_currency")
def country_currency(spark, sf_dir):
    """Currency signs in the probe texts, gathered by customer-sized groups of units, and in pages."""
    pages_part = _signals(spark, sf_dir).select(F.lit("page").alias("src"), c("page_id").alias("id"), "sample")
    orders = tables.read(spark, sf_dir, "orders").select(
        F.lit("order").alias("src"), c("o_orderkey").alias("id"),
        F.concat(F.repeat(F.lit("£9 "), (c("o_orderkey") % 5).cast("int")),
                 F.repeat(F.lit("₹8 "), (c("o_custkey") % 6).cast("int")),
                 F.repeat(F.lit("₽ "), (c("o_orderkey") % 7).cast("int"))).alias("sample"))
    return pages_part.unionByName(orders).select(
        "src", "id", country.country_currency(c("sample")).alias("country"))


@query("page_country")
def page_country(spark, sf_dir):
    return _signals(spark, sf_dir).select("page_id", country.page_country(
        c("metas"), c("lang"), c("host"), c("sample")).alias("country"))


@query("url_parts")
def url_parts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.url_parts(c("url")).alias("u")).select("page_id", "u.*")


@query("restricted_url")
def restricted_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.restricted(c("url")).alias("restricted"))


@query("meaningful_text")
def meaningful_text(spark, sf_dir):
    """Elements with text of their own."""
    def opened(ns):
        return let(elements.with_own_text(ns), lambda texty: F.transform(
            F.filter(ns, lambda n: n["kind"] == "open"),
            lambda n: F.struct(n["pos"].alias("pos"), n["tag"].alias("tag"), marked(texty, n["pos"]).alias("has_text"))))
    return parsed(spark, sf_dir).select("page_id", F.inline(let(c("nodes"), opened)))


@query("title_redact")
def title_redact(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.md5(mask.title_redact(c("html"))).alias("html_md5"))


def scan_pages(df, country_col=None, email=True, numeric=True):
    """Findings of pages ``(page_id, url, html, ...)``: node by node, with lone numbers rescued.

    The country and the policy columns are settled per page before its nodes
    are exploded; the html itself is dropped there.
    """
    ts = c("ts")
    here = country.page_country(html.metas(c("html"), ts), html.html_lang(c("html"), ts),
                                U.url_parts(c("url"))["host"], html.body_sample(c("html"), ts))
    flags = {"email_on": email if not isinstance(email, bool) else F.lit(email),
             "numeric_on": numeric if not isinstance(numeric, bool) else F.lit(numeric)}
    nodes = with_once(with_once(df, ts=html.tokens(c("html"))), country=here if country_col is None else country_col,
                      units=html.text_nodes(html.tree(c("html"), ts)), **flags).select(
        "page_id", "country", "email_on", "numeric_on", F.inline("units"))
    scanned = resolve.with_matches(nodes, email="email_on", numeric="numeric_on")
    rescue = F.when((F.size("m") == 0) & c("numeric_on") & (F.length("text") >= 4),
                    html.cross_node_match(c("text"), c("preceding")))
    return scanned.select("page_id", "pos", "country", F.inline(F.coalesce(rescue, c("m")))).select(
        "page_id", "pos", "country", c("start").alias("start_pos"), c("end").alias("end_pos"),
        "type", "detector", c("text").alias("hit"))


@query("cross_node_keyword")
def cross_node_keyword(spark, sf_dir):
    """Lone numbers announced by a keyword in the text before them, in nodes without a finding of their own."""
    return scan_pages(pages(spark, sf_dir)).where(c("detector") == "cross_node_keyword").select(
        "page_id", "pos", "start_pos", "end_pos", "hit")


@query("page_scan")
def page_scan(spark, sf_dir):
    """Findings of every page, under the country of the page."""
    return scan_pages(pages(spark, sf_dir))
