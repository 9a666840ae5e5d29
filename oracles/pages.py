"""Pages in SQL: tokens, open elements by recursion over token positions, text nodes."""

from __future__ import annotations

from maskwright import values as V
from maskwright.operators import html as H
from maskwright.sources import rich_pages

from .dialect import has, q, re2

TOKEN = H.TOKEN.replace("*+", "*").replace("++", "+")
RAW = "(SELECT page_id, url, html FROM pages)"
RICH = f"({rich_pages.SELECT_SQL})"


def _in(x: str, words) -> str:
    return f"{x} IN ({', '.join(q(w) for w in words)})"


def token_rows(src: str) -> str:
    """``(page_id, pos, kind, tag, token)``."""
    tag = r"lower(regexp_extract(token, '^(?i)</?([a-z][^\s/>]*)', 1))"
    return f"""
    SELECT page_id, pos, kind, CASE WHEN kind IN ('close', 'raw', 'void', 'open') THEN t END AS tag, token FROM (
      SELECT *, CASE WHEN starts_with(token, '<!--') THEN 'comment' WHEN starts_with(token, '<!') THEN 'doctype'
        WHEN t = '' THEN 'text' WHEN starts_with(token, '</') THEN 'close'
        WHEN t IN ('script', 'style', 'noscript', 'textarea', 'title') THEN 'raw'
        WHEN {_in('t', V.VOID_TAGS)} OR ends_with(token, '/>') THEN 'void' ELSE 'open' END AS kind
      FROM (SELECT page_id, token, CAST(i - 1 AS INT) AS pos, {tag} AS t FROM (
        SELECT page_id, unnest(ts) AS token, unnest(range(1, len(ts) + 1)) AS i FROM (
          SELECT page_id, regexp_extract_all(html, {q(TOKEN)}) AS ts FROM {src}))))"""


def _last(stack: str, words) -> str:
    cond = f"list_contains([{', '.join(q(w) for w in words)}], x)"
    return (f"coalesce(list_max(list_filter(list_transform(range(0, len({stack})), lambda i: "
            f"CASE WHEN list_contains([{', '.join(q(w) for w in words)}], {stack}[i + 1].tag) THEN i ELSE -1 END), "
            f"lambda v: v >= 0)), -1)") if cond else ""


def _opened() -> str:
    arms = []
    for tags, closed, shields in H.IMPLIED_END:
        target, shield = _last("w.after", closed), _last("w.after", shields)
        arms.append(f"WHEN {_in('t.tag', tags)} THEN CASE WHEN {target} > {shield} "
                    f"THEN w.after[1:{target}] ELSE w.after END")
    same = ("coalesce(list_max(list_filter(list_transform(range(0, len(w.after)), lambda i: "
            "CASE WHEN w.after[i + 1].tag = t.tag THEN i ELSE -1 END), lambda v: v >= 0)), -1)")
    return (f"CASE WHEN t.kind IN ('open', 'void', 'raw') THEN CASE {' '.join(arms)} ELSE w.after END "
            f"WHEN t.kind = 'close' THEN CASE WHEN {same} >= 0 THEN w.after[1:{same}] ELSE w.after END "
            f"ELSE w.after END")


def with_tree(src: str) -> str:
    """CTE text that defines ``toks`` and ``nodes(page_id, pos, kind, tag, token, parent, ancestors, seg)``."""
    frame = "STRUCT(tag VARCHAR, pos INT)[]"
    block = f"CASE WHEN coalesce({_in('t.tag', V.BLOCK_TAGS)}, false) THEN 1 ELSE 0 END"
    return f"""
    WITH RECURSIVE toks AS MATERIALIZED ({token_rows(src)}),
    walk AS (
      SELECT page_id, CAST(-1 AS INT) AS pos, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS tag,
        CAST(NULL AS VARCHAR) AS token, CAST([] AS {frame}) AS st, CAST([] AS {frame}) AS after,
        CAST(0 AS INT) AS seg, CAST(0 AS INT) AS next_seg
      FROM (SELECT DISTINCT page_id FROM toks)
      UNION ALL
      SELECT page_id, pos, kind, tag, token, st,
        CASE WHEN kind = 'open' THEN list_append(st, struct_pack(tag := tag, pos := pos)) ELSE st END,
        seg, CAST(seg + add_seg AS INT)
      FROM (SELECT t.page_id, t.pos, t.kind, t.tag, t.token, w.next_seg AS seg, {block} AS add_seg,
              CAST({_opened()} AS {frame}) AS st
            FROM walk w JOIN toks t ON t.page_id = w.page_id AND t.pos = w.pos + 1)),
    nodes AS MATERIALIZED (
      SELECT page_id, pos, kind, tag, token, CASE WHEN len(st) > 0 THEN st[-1].pos ELSE -1 END AS parent,
        list_transform(st, lambda s: s.pos) AS ancestors, seg FROM walk WHERE pos >= 0)"""


def attribute(token: str, name: str) -> str:
    p = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+)"""
    return (f"CASE WHEN regexp_matches({token}, {q(p)}) THEN "
            f"regexp_replace(regexp_extract({token}, {q(p)}, 1), '^[\"'']|[\"'']$', '', 'g') END")


def has_attribute(token: str, name: str) -> str:
    return f"regexp_matches({token}, {q(rf'(?is)[[:space:]]{name}([[:space:]]|[=/>])')})"


#: The references that the pages of the driver and their additions hold.
NAMED = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("copy", "\u00a9"), ("middot", "\u00b7"), ("pound", "\u00a3"))


def decode(x: str) -> str:
    out = x
    for name, char in NAMED:
        out = f"regexp_replace({out}, '&{name};?', {q(char)}, 'g')"
    nums = f"regexp_extract_all({out}, '&#([0-9]{{1,6}});?', 1)"
    parts = f"string_split_regex({out}, '&#[0-9]{{1,6}};?')"
    joined = (f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda i: {parts}[i] || "
              f"CASE WHEN i <= len({nums}) THEN chr(CAST({nums}[i] AS INT)) ELSE '' END), '')")
    return (f"CASE WHEN contains({x}, '&') THEN regexp_replace(CASE WHEN regexp_matches({x}, '&#[0-9]{{1,6}};?') "
            f"THEN {joined} ELSE {out} END, '&amp;?', '&', 'g') ELSE {x} END")


def with_text_nodes(src: str) -> str:
    """Adds ``roots``, ``visible(page_id, pos, parent, seg, text)`` and ``units`` with ``preceding``."""
    cls = f"coalesce({attribute('n.token', 'class')}, '')"
    editors = ", ".join(q(c) for c in V.EDITOR_CLASSES)
    short = re2(V.SHORT_DIGIT_NODE)
    return f"""{with_tree(src)},
    elems AS MATERIALIZED (SELECT * FROM nodes WHERE kind IN ('open', 'raw', 'void')),
    coded AS (SELECT DISTINCT page_id, unnest(ancestors) AS pos FROM elems WHERE tag = 'code'),
    framed AS (SELECT page_id, pos FROM elems n WHERE tag = 'div' AND contains({cls}, 'highlight')),
    roots AS MATERIALIZED (
      SELECT n.page_id, n.pos FROM elems n
      LEFT JOIN coded c ON c.page_id = n.page_id AND c.pos = n.pos
      LEFT JOIN framed f ON f.page_id = n.page_id AND f.pos = n.parent
      WHERE {_in('n.tag', V.SKIP_TAGS)}
        OR (n.tag = 'pre' AND (c.pos IS NOT NULL OR f.pos IS NOT NULL OR contains({cls}, 'highlight')
            OR contains({cls}, 'lang') OR {has_attribute('n.token', 'data-code')}))
        OR {has_attribute('n.token', 'data-code')}
        OR len(list_intersect(string_split_regex({cls}, '\\s+'), [{editors}])) > 0),
    bodies AS (SELECT page_id, pos FROM nodes WHERE kind = 'open' AND tag = 'body'),
    above AS MATERIALIZED (SELECT page_id, pos, unnest(ancestors) AS anc FROM nodes WHERE kind = 'text'),
    visible AS MATERIALIZED (
      SELECT n.page_id, n.pos, n.parent, n.seg, n.token, {decode('n.token')} AS text FROM nodes n
      WHERE n.kind = 'text'
        AND NOT EXISTS (SELECT 1 FROM above a JOIN roots r ON r.page_id = a.page_id AND r.pos = a.anc
                        WHERE a.page_id = n.page_id AND a.pos = n.pos)
        AND (NOT EXISTS (SELECT 1 FROM bodies b WHERE b.page_id = n.page_id)
          OR EXISTS (SELECT 1 FROM above a JOIN bodies b ON b.page_id = a.page_id AND b.pos = a.anc
                     WHERE a.page_id = n.page_id AND a.pos = n.pos))),
    units AS MATERIALIZED (
      SELECT v.page_id, v.pos, v.parent, v.text,
        CASE WHEN regexp_matches(v.text, {q(short)}) THEN right(coalesce((
          SELECT string_agg(u.text, '' ORDER BY u.pos) FROM visible u
          WHERE u.page_id = v.page_id AND u.seg = v.seg AND u.pos < v.pos), ''), {V.PRECEDING_LIMIT}) END AS preceding
      FROM visible v)"""


def metas(src: str) -> str:
    return f"""SELECT page_id, CAST(i AS INT) AS ord, coalesce({attribute('m', 'name')}, '') AS name,
      coalesce({attribute('m', 'property')}, '') AS property, coalesce({attribute('m', 'http-equiv')}, '') AS http_equiv,
      coalesce({attribute('m', 'content')}, '') AS content
      FROM (SELECT page_id, token AS m, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS i
            FROM ({token_rows(src)}) WHERE regexp_matches(token, '^(?i)<meta[[:space:]/>]'))"""


def lang(html: str) -> str:
    tag = (f"list_filter(regexp_extract_all({html}, {q(TOKEN)}), lambda t: regexp_matches(t, '^(?i)<html[[:space:]/>]'))[1]")
    return f"coalesce({attribute(tag, 'lang')}, '')"


def sample(html: str) -> str:
    toks = f"regexp_extract_all({html}, {q(TOKEN)})"
    body = f"list_position(list_transform({toks}, lambda t: regexp_matches(t, '^(?i)<body[[:space:]/>]')), true)"
    raw = "regexp_matches(t, '^(?i)<(script|style|noscript|textarea|title)\\b')"
    held = "regexp_extract(t, '^(?is)<[a-z]+\\b[^>]*>(.*?)(?:</[a-z]+\\s*>)?$', 1)"
    text = (f"CASE WHEN {raw} THEN {held} WHEN regexp_matches(t, '^(?i)(<!|</?[a-z])') THEN '' ELSE {decode('t')} END")
    return (f"substring(CASE WHEN {body} > 0 THEN array_to_string(list_transform({toks}[{body} + 1:], lambda t: {text}), '') "
            f"ELSE '' END, 1, {V.CURRENCY_SAMPLE})")


def country_lang(x: str) -> str:
    p = q(re2(V.LANG_REGION))
    return f"CASE WHEN regexp_matches({x}, {p}) THEN upper(regexp_extract({x}, {p}, 1)) END"


def country_meta_rows(src: str) -> str:
    """``(page_id, country)`` of the first meta that names one."""
    named = "upper(trim(content))"
    return f"""SELECT page_id, arg_min(country, ord) AS country FROM (
      SELECT page_id, ord, coalesce(
        CASE WHEN lower(name) IN ('geo.country', 'country') AND regexp_matches({named}, '^[A-Z]{{2}}$') THEN {named} END,
        CASE WHEN 'content-language' IN (lower(name), lower(http_equiv)) OR lower(property) = 'og:locale'
          THEN {country_lang('content')} END) AS country FROM ({metas(src)}))
      WHERE country IS NOT NULL GROUP BY page_id"""


def country_tld(host: str) -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in V.TLD_COUNTRY.items())
    return (f"CASE WHEN contains({host}, '.') THEN MAP {{{pairs}}}[split_part(lower({host}), '.', -1)] END")


def country_currency(s: str) -> str:
    counts = [f"(length({s}) - length(replace({s}, {q(sign)}, '')))" for sign, _ in V.CURRENCY_COUNTRY]
    arms = " ".join(f"WHEN {c} = greatest({', '.join(counts)}) AND {c} > 2 THEN {q(k)}"
                    for c, (_, k) in zip(counts, V.CURRENCY_COUNTRY))
    return f"CASE {arms} END"
