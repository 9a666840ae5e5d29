"""Driver pages with the markup they lack, derived row by row from ``pages``.

The raw pages have no identifiers, roles, code blocks, meta countries or
element-spanning labels. Plain ``replace`` calls, valid in both engines, add
them with values taken from the page key.
"""

from __future__ import annotations

_K = "CAST(page_id AS STRING)"
_NUM = "CAST(10000 + page_id * 37 % 90000 AS STRING)"

_HEAD = (
    "'<head>' || CASE page_id % 9 "
    "WHEN 0 THEN '<meta name=\"geo.country\" content=\" gb \">' "
    "WHEN 1 THEN '<meta http-equiv=\"Content-Language\" content=\"en-US\">' "
    "WHEN 2 THEN '<meta property=\"og:locale\" content=\"nl_NL\">' "
    "WHEN 3 THEN '<meta name=\"country\" content=\"xyz\"><meta name=\"content-language\" content=\"fr\">' "
    "WHEN 4 THEN '<link rel=\"shortcut icon\" href=\"/i/' || " + _K + " || '.ico\">' "
    "ELSE '' END"
)
_LANG = (
    "CASE page_id % 7 WHEN 0 THEN ' lang=\"en-AU\"' WHEN 1 THEN ' lang=\"zh-Hant-TW\"' "
    "WHEN 2 THEN ' lang=''pt_BR''' ELSE ' lang=\"en\"' END"
)
_NAV = "'<nav id=\"menu\" aria-label=\"Main\">'"
_DIV = (
    "'<div class=\"ad box-' || CAST(page_id % 3 AS STRING) || '\" data-testid=\"ad\">'"
    " || CASE WHEN page_id % 5 = 0 THEN '<span class=\"tag hot\">' || " + _NUM + " || '</span>' ELSE '' END"
)
_TAIL = (
    "'<section id=\"extra\" data-name=\"extra\"><p><strong>Customer ID:</strong> <span>' || " + _NUM + " || '</span></p>'"
    " || '<p>Ticket no</p><p><span>' || " + _NUM + " || '</span></p>'"
    " || '<p>Year <em>key: </em><b>20' || CAST(10 + page_id % 80 AS STRING) || '</b></p>'"
    " || '<pre>Ref 77' || " + _NUM + " || '</pre><pre class=\"lang-py\">x = 88' || " + _NUM + " || '</pre>'"
    " || '<pre>a<code>99' || " + _NUM + " || '</code> 66' || " + _NUM + " || '</pre>'"
    " || '<div class=\"highlight\"><pre>55' || " + _NUM + " || '</pre></div><div data-code=\"1\">44' || " + _NUM + " || '</div>'"
    " || '<div class=\"x cm-editor\">33' || " + _NUM + " || '</div><kbd>22' || " + _NUM + " || '</kbd>'"
    " || '<noscript>11' || " + _NUM + " || '</noscript>'"
    " || '<div role=\"button\" class=\"btn\">Go</div><button name=\"send\">Send <i>now</i></button><button name=\"send\"></button>'"
    " || '<img src=\"a.png\" alt=\"1 > 0\"><input name=\"q\"><x-card>card</x-card><x-empty></x-empty>'"
    " || '<a class=\"btn\"><slot name=\"s\"></slot></a><table><tr><td>Cell ' || " + _NUM + " || '<td> <tr><th>Total</th></table>'"
    " || '<dl><dt>Owner<dd>user' || " + _K + " || '@example.org</dl><p>Pay &#163;5 &pound; &#163;6 &#163;7 now &lt;b&gt;&nbsp;ok</p>'"
    " || '<div id=\"dup\"><span aria-label=\"close\">x</span></div><div id=\"dup\"><span>y</span></div></section><footer>'"
)
HTML_SQL = (
    "replace(replace(replace(replace(replace(html, '<head>', " + _HEAD + "), ' lang=\"en\"', " + _LANG + "), "
    "'<nav>', " + _NAV + "), '<div class=\"ad\">', " + _DIV + "), '<footer>', " + _TAIL + ")"
)
URL_SQL = (
    "CASE page_id % 11 WHEN 0 THEN replace(url, '.com/', '.co.uk/') WHEN 1 THEN replace(url, '.net/', '.net:8080/') "
    "WHEN 2 THEN replace(url, '.org/', '.de/') WHEN 3 THEN replace(replace(url, 'https://', 'chrome://'), 'http://', 'HTTP://') "
    "WHEN 4 THEN replace(url, '://', ':/') WHEN 5 THEN replace(url, '.example.com/', '.example.com:443/') ELSE url END"
)
SELECT_SQL = f"SELECT page_id, {URL_SQL} AS url, {HTML_SQL} AS html FROM pages"


def enriched(pages):
    """Any ``pages`` DataFrame, streaming or not."""
    return pages.selectExpr("page_id", f"{URL_SQL} AS url", f"{HTML_SQL} AS html")


def rich_pages(spark, sf_dir: str):
    return enriched(spark.read.parquet(f"{sf_dir}/pages.parquet"))
