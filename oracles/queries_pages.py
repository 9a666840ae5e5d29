"""SQL for the page queries."""

from __future__ import annotations

from maskwright import values as V
from maskwright.functions.rx import SPACE

from . import detection as D
from . import pages as P
from .dialect import q, re2

SQL: dict[str, str] = {}
RAW, RICH = P.RAW, P.RICH

SQL["page_nodes"] = P.token_rows(RAW)
SQL["page_tokens_complete"] = f"SELECT page_id, true AS complete FROM {RICH}"
SQL["element_parent"] = P.with_tree(RICH) + (
    " SELECT page_id, pos, tag, parent, CAST(len(ancestors) AS INT) AS depth FROM nodes WHERE kind IN ('open', 'void', 'raw')")
SQL["page_text_nodes"] = P.with_text_nodes(RICH) + " SELECT page_id, pos, parent, text FROM units"
SQL["code_pre_skip"] = P.with_text_nodes(RICH) + (
    " SELECT n.page_id, n.pos, r.pos IS NOT NULL AS skipped FROM nodes n LEFT JOIN roots r ON r.page_id = n.page_id "
    "AND r.pos = n.pos WHERE n.kind = 'open' AND n.tag = 'pre'")
SQL["preceding_text"] = P.with_text_nodes(RICH) + (
    " SELECT page_id, pos, text, preceding FROM units WHERE preceding IS NOT NULL")


def trail(x: str) -> str:
    return f"regexp_matches({x}, {q(re2(V.KEYWORD_TRAIL, True))})"


_BLANKS = "^[" + SPACE + "]*"
_cross = (f"SELECT page_id, pos, CAST(length(regexp_extract(text, {q(_BLANKS)})) AS INT) AS start_pos, "
          f"regexp_extract(text, {q('[0-9][0-9 -]*[0-9]')}) AS hit FROM units WHERE preceding IS NOT NULL AND {trail('preceding')}")
SQL["metas"] = P.metas(RICH)


def url_field(url: str, group: int) -> str:
    web = r"^(?i)(https?|ftp|wss?):[/\\]*(?:[^/?#@\\]*@)?(\[[^\]]*\]|[^:/?#\\]*)(?::([0-9]*))?([^?#]*)"
    other = r"^(?i)([a-z][a-z0-9+.\-]*):(?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)(?::([0-9]*))?)?([^?#]*)"
    return (f"CASE WHEN regexp_matches({url}, '^(?i)(https?|ftp|wss?):') THEN regexp_extract({url}, {q(web)}, {group}) "
            f"ELSE regexp_extract({url}, {q(other)}, {group}) END")


SPECIAL = "('http', 'https', 'ftp', 'ws', 'wss')"
SCHEME, HOST = f"lower({url_field('url', 1)})", f"lower({url_field('url', 2)})"
PORT, PATH = url_field("url", 3), url_field("url", 4)
IS_URL = f"(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT ({SCHEME} IN {SPECIAL} AND {HOST} = ''))"


def parts(src: str) -> str:
    """``src`` plus scheme, host, port, path; all null when the url is none."""
    default = (f"CASE {SCHEME} WHEN 'http' THEN '80' WHEN 'ws' THEN '80' WHEN 'https' THEN '443' "
               f"WHEN 'wss' THEN '443' WHEN 'ftp' THEN '21' ELSE '' END")
    return (f"(SELECT *, CASE WHEN {IS_URL} THEN {SCHEME} END AS scheme, CASE WHEN {IS_URL} THEN {HOST} END AS host, "
            f"CASE WHEN {IS_URL} THEN CASE WHEN {PORT} = {default} THEN '' ELSE {PORT} END END AS port, "
            f"CASE WHEN {IS_URL} THEN CASE WHEN {SCHEME} IN {SPECIAL} AND {PATH} = '' THEN '/' ELSE {PATH} END END AS path "
            f"FROM {src})")


SQL["url_parts"] = f"SELECT page_id, scheme, host, port, path FROM {parts(RICH)}"
SQL["restricted_url"] = f"""
SELECT page_id, coalesce(scheme IS NULL OR scheme IN ({', '.join(map(q, V.RESTRICTED_SCHEMES))})
  OR host = {q(V.STORE_HOST)} OR (host = {q(V.STORE_PATH_HOST)} AND starts_with(path, {q(V.STORE_PATH)})), true) AS restricted
FROM {parts(RICH)}"""
SIGNALS = (f"(SELECT p.page_id, p.host, m.country AS meta, {P.lang('html')} AS lang, {P.sample('html')} AS sample "
           f"FROM {parts(RICH)} p LEFT JOIN ({P.country_meta_rows(RICH)}) m ON m.page_id = p.page_id)")
SQL["country_meta"] = f"SELECT page_id, meta AS country FROM {SIGNALS}"
SQL["country_lang"] = f"SELECT page_id, lang, {P.country_lang('lang')} AS country FROM {SIGNALS}"
SQL["country_tld"] = f"SELECT page_id, host, {P.country_tld('host')} AS country FROM {SIGNALS}"
SQL["country_currency"] = (
    f"SELECT 'page' AS src, page_id AS id, {P.country_currency('sample')} AS country FROM {SIGNALS} UNION ALL "
    f"SELECT 'order', id, {P.country_currency('sample')} FROM (SELECT o_orderkey AS id, "
    f"repeat('£9 ', o_orderkey % 5) || repeat('₹8 ', o_custkey % 6) || repeat('₽ ', o_orderkey % 7) AS sample FROM orders)")
COUNTRY = (f"(SELECT page_id, coalesce(meta, {P.country_lang('lang')}, {P.country_tld('host')}, "
           f"{P.country_currency('sample')}) AS country FROM {SIGNALS})")
SQL["page_country"] = f"SELECT page_id, country FROM {COUNTRY}"
SQL["meaningful_text"] = P.with_tree(RICH) + f""",
texty AS (SELECT DISTINCT page_id, parent FROM nodes WHERE kind = 'text' AND regexp_matches({P.decode('token')}, {q('[^' + SPACE + ']')}))
SELECT n.page_id, n.pos, n.tag, t.parent IS NOT NULL AS has_text FROM nodes n
LEFT JOIN texty t ON t.page_id = n.page_id AND t.parent = n.pos WHERE n.kind = 'open'"""

_icon = r"""(?i)(<link\b[^>]*\bhref\s*=\s*)("[^"]*"|'[^']*'|[^\s"'>]+)"""
_titled = f"regexp_replace(html, '(?is)(<title\\b[^>]*>).*?(</title\\s*>)', '\\1{V.REPLACEMENT_TITLE}\\2', 'g')"
SQL["title_redact"] = (
    f"SELECT page_id, md5(CASE WHEN regexp_matches(html, '(?i)<link\\b[^>]*\\brel\\s*=\\s*[\"'']?[^\"''>]*icon') "
    f"THEN regexp_replace({_titled}, {q(_icon)}, '\\1\"{V.BLANK_ICON}\"', 'g') "
    f"ELSE regexp_replace({_titled}, '(?i)</head\\s*>', '<link rel=\"icon\" href=\"{V.BLANK_ICON}\"></head>', 'g') END) AS html_md5 "
    f"FROM {RICH}")

# Node findings keyed by one number per node; a page has far fewer nodes than the factor.
NODE = 1000000
_nodes = f"(SELECT u.page_id * {NODE} + u.pos AS id, u.text, k.country FROM units u JOIN country k ON k.page_id = u.page_id)"


def page_findings(email: str = "true", numeric: str = "true", flags: str | None = None) -> str:
    """CTEs up to ``out(page_id, pos, country, start_pos, end_pos, type, detector, hit)``."""
    src = "keyed"
    extra = f", {flags}" if flags else ""
    return f"""{P.with_text_nodes(RICH)},
    country AS MATERIALIZED (SELECT * FROM {COUNTRY}){extra},
    keyed AS MATERIALIZED (SELECT * FROM {_nodes}),
    own AS MATERIALIZED ({D.findings(src, email=email, numeric=numeric)}),
    crossed AS (
      SELECT x.page_id, x.pos, k.country, x.start_pos, CAST(x.start_pos + length(x.hit) AS INT) AS end_pos,
        'numeric' AS type, 'cross_node_keyword' AS detector, x.hit
      FROM ({_cross}) x JOIN country k ON k.page_id = x.page_id
      JOIN (SELECT id FROM keyed WHERE length(text) >= 4 AND ({numeric})) t ON t.id = x.page_id * {NODE} + x.pos
      WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.id = x.page_id * {NODE} + x.pos)),
    found AS (
      SELECT o.id // {NODE} AS page_id, CAST(o.id % {NODE} AS INT) AS pos, k.country, o.start_pos, o.end_pos, o.type, o.detector, o.hit
      FROM own o JOIN country k ON k.page_id = o.id // {NODE}
      UNION ALL SELECT * FROM crossed)"""


SQL["cross_node_keyword"] = page_findings() + " SELECT page_id, pos, start_pos, end_pos, hit FROM crossed"
SQL["page_scan"] = page_findings() + " SELECT * FROM found"
