"""SQL for element categories and addresses."""

from __future__ import annotations

from maskwright import values as V
from maskwright.functions.rx import SPACE
from maskwright.operators import elements as E

from . import pages as P
from . import queries_policy as QP
from .dialect import q

SQL: dict[str, str] = {}
RICH = P.RICH
TREE = P.with_tree(RICH)
EL = "kind IN ('open', 'void', 'raw')"
DIM = [(cat, kind, name, i) for cat in V.CATEGORY_ORDER for kind in ("always", "check", "role")
       for i, name in enumerate(V.CATEGORY_TAGS[cat][kind])]
DIM_SQL = "(VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(n)}, {i})" for a, b, n, i in DIM) + ") dim(category, kind, name, ord)"
ROLE = P.attribute("token", "role")

SQL["category_dim"] = TREE + f""",
el AS (SELECT tag, {ROLE} AS role FROM nodes WHERE {EL})
SELECT category, kind, name, CAST(ord AS INT) AS ord, CASE WHEN kind = 'role' THEN (SELECT count(*) FROM el WHERE role = name)
  ELSE (SELECT count(*) FROM el WHERE tag = name) END AS elements FROM {DIM_SQL}"""


def _size(kind: str) -> str:
    return " + ".join(f"CASE WHEN cat_{cat} THEN {len(V.CATEGORY_TAGS[cat][kind])} ELSE 0 END" for cat in V.CATEGORY_ORDER)


SQL["category_select"] = (
    "SELECT profile, " + " || ".join(f"CASE WHEN cat_{cat} THEN '1' ELSE '0' END" for cat in V.CATEGORY_ORDER)
    + f" AS key, {_size('always')} AS always_tags, {_size('check')} AS check_tags, {_size('role')} AS roles FROM ({QP.LOADED})")
SQL["element_category"] = TREE + f""",
d AS (SELECT * FROM {DIM_SQL})
SELECT page_id, pos, tag, t.category AS tag_category, r.category AS role_category
FROM (SELECT page_id, pos, tag, {ROLE} AS role FROM nodes WHERE {EL}) e
LEFT JOIN d t ON t.kind <> 'role' AND t.name = e.tag LEFT JOIN d r ON r.kind = 'role' AND r.name = e.role
WHERE t.category IS NOT NULL OR r.category IS NOT NULL"""


def _list(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")" if words else "('')"


def cover(categories, thorough: bool = False) -> str:
    """CTEs up to ``cov(page_id, pos, tag, how)``."""
    always, check, roles = (E.names(categories, k) for k in ("always", "check", "role"))
    th = str(thorough).lower()
    custom = str(bool({"text", "structure"} & set(categories))).lower()
    return TREE + f""",
texty AS (SELECT DISTINCT page_id, parent AS pos FROM nodes WHERE kind = 'text' AND regexp_matches({P.decode('token')}, {q('[^' + SPACE + ']')})),
slotted AS (SELECT DISTINCT page_id, unnest(ancestors) AS pos FROM nodes WHERE tag = 'slot' AND kind <> 'close'),
cov AS MATERIALIZED (SELECT * FROM (SELECT n.page_id, n.pos, n.tag, CASE WHEN n.tag IN {_list(always)} THEN 'always'
  WHEN contains(n.tag, '-') THEN CASE WHEN {custom} AND ({th} OR t.pos IS NOT NULL) THEN 'custom' WHEN role IN {_list(roles)} THEN 'role' END
  WHEN n.tag IN {_list(check)} AND CASE WHEN n.tag IN {_list(E.STRUCTURAL)} THEN t.pos IS NOT NULL
    ELSE {th} OR t.pos IS NOT NULL OR s.pos IS NOT NULL END THEN 'text'
  WHEN role IN {_list(roles)} THEN 'role' END AS how
  FROM (SELECT *, {ROLE} AS role FROM nodes WHERE {EL}) n LEFT JOIN texty t ON t.page_id = n.page_id AND t.pos = n.pos
  LEFT JOIN slotted s ON s.page_id = n.page_id AND s.pos = n.pos) WHERE how IS NOT NULL)"""


DEFAULT = cover(V.DEFAULT_CATEGORIES)
SQL["element_cover"] = DEFAULT + " SELECT * FROM cov"
SQL["element_cover_thorough"] = cover(V.CATEGORY_ORDER, True) + " SELECT * FROM cov"
SQL["cover_count"] = DEFAULT + " SELECT page_id, how, count(*) AS n FROM cov GROUP BY page_id, how"
SQL["visually_covered"] = cover(("form", "table")) + " SELECT tag, how, count(*) AS n FROM cov GROUP BY tag, how"
UNDER = DEFAULT + """,
up AS (SELECT page_id, pos, unnest(ancestors) AS anc FROM nodes WHERE kind = 'text'),
near AS (SELECT u.page_id, u.pos, max(u.anc) AS under FROM up u JOIN cov c ON c.page_id = u.page_id AND c.pos = u.anc GROUP BY 1, 2)"""
SQL["nearest_covered_ancestor"] = UNDER + """
SELECT n.page_id, n.pos, x.under FROM nodes n LEFT JOIN near x ON x.page_id = n.page_id AND x.pos = n.pos WHERE n.kind = 'text'"""
SQL["mask_category_text"] = UNDER + f"""
SELECT n.page_id, n.pos, x.under, repeat('●', length({P.decode('n.token')})) AS masked
FROM nodes n JOIN near x ON x.page_id = n.page_id AND x.pos = n.pos WHERE n.kind = 'text'"""
SQL["batch_top_nodes"] = TREE + """,
ch AS (SELECT page_id, pos, ancestors FROM nodes WHERE kind IN ('open', 'text') AND pos % 7 = 3),
up AS (SELECT page_id, pos, unnest(ancestors) AS anc FROM ch)
SELECT page_id, pos FROM ch WHERE NOT EXISTS (SELECT 1 FROM up JOIN ch a ON a.page_id = up.page_id AND a.pos = up.anc
  WHERE up.page_id = ch.page_id AND up.pos = ch.pos)"""


def esc(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([^A-Za-z0-9_\-\x{{80}}-\x{{10FFFF}}])', '\\\1', 'g'), '^([0-9])', '\\3\1 ')"


def quo(x: str) -> str:
    return f"('\"' || regexp_replace({x}, '([\"\\\\])', '\\\\\\1', 'g') || '\"')"


def rows(src: str) -> str:
    """CTEs up to ``el`` (attributes) and ``steps`` (step of every element)."""
    head = "regexp_extract(token, '^<[^>]*>')"
    stable = ", ".join(
        f"CASE WHEN trim({P.attribute(head, a)}) <> '' THEN struct_pack(ord := {i}, name := {q(a)}, value := trim({P.attribute(head, a)}), raw := {P.attribute(head, a)}) END"
        for i, a in enumerate(V.STABLE_ATTRIBUTES))
    return P.with_tree(src) + f""",
el AS MATERIALIZED (SELECT page_id, pos, tag, parent, ancestors, {P.attribute(head, 'id')} AS id, {P.attribute(head, 'aria-label')} AS aria,
  list_filter(string_split_regex(coalesce({P.attribute(head, 'class')}, ''), '\\s+'), lambda x: x <> '') AS classes,
  list_filter([{stable}], lambda s: s IS NOT NULL) AS stable FROM nodes WHERE {EL}),
steps AS MATERIALIZED (SELECT page_id, pos, tag, tag || ':nth-of-type(' || row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY pos) || ')' AS step FROM el),
chain AS MATERIALIZED (SELECT e.page_id, e.pos, a.anc, s.step, s.tag FROM (SELECT page_id, pos, unnest(list_append(ancestors, pos)) AS anc FROM el) a
  JOIN el e ON e.page_id = a.page_id AND e.pos = a.pos JOIN steps s ON s.page_id = a.page_id AND s.pos = a.anc),
tops AS (SELECT page_id, pos, coalesce(max(anc) FILTER (tag = 'body'), max(anc) FILTER (tag = 'html'), -1) AS top FROM chain GROUP BY 1, 2),
by_path AS (SELECT c.page_id, c.pos, 'body > ' || string_agg(c.step, ' > ' ORDER BY c.anc) AS sel FROM chain c
  JOIN tops t ON t.page_id = c.page_id AND t.pos = c.pos WHERE c.anc > t.top GROUP BY 1, 2),
flat AS (SELECT page_id, pos, tag, s.ord AS ord, s.name AS name, s.value AS value, s.raw AS raw FROM (SELECT page_id, pos, tag, unnest(stable) AS s FROM el)),
by_data AS (SELECT page_id, pos, arg_min(sel, ord) AS sel FROM (SELECT page_id, pos, ord, CASE WHEN a = 1 THEN b WHEN t = 1 THEN tag || b END AS sel FROM (
  SELECT *, '[' || name || '=' || {quo('value')} || ']' AS b, count(*) OVER (PARTITION BY page_id, name, raw) AS a,
  count(*) OVER (PARTITION BY page_id, name, raw, tag) AS t FROM flat) WHERE raw = value) WHERE sel IS NOT NULL GROUP BY 1, 2),
by_id AS (SELECT page_id, pos, '#' || {esc('id')} AS sel FROM (SELECT *, count(*) OVER (PARTITION BY page_id, id) AS n FROM el WHERE id <> '')
  WHERE n = 1 AND id = trim(id)),
by_aria AS (SELECT page_id, pos, tag || '[aria-label=' || {quo('aria')} || ']' AS sel FROM (SELECT *, count(*) OVER (PARTITION BY page_id, tag, aria) AS n
  FROM el WHERE aria <> '') WHERE n = 1 AND aria = trim(aria) AND length(aria) <= {V.ARIA_LABEL_LIMIT}),
classed AS (SELECT e.page_id, e.pos, e.tag, e.classes, p.id AS pid, e.tag || '.' || array_to_string(list_transform(e.classes, lambda x: {esc('x')}), '.') AS own
  FROM el e LEFT JOIN el p ON p.page_id = e.page_id AND p.pos = e.parent AND p.id <> '' WHERE len(e.classes) > 0),
by_class AS (SELECT c.page_id, c.pos, CASE WHEN c.pid IS NOT NULL AND (SELECT count(*) FROM classed o WHERE o.page_id = c.page_id AND o.pid = c.pid
  AND o.tag = c.tag AND len(list_filter(c.classes, lambda x: NOT list_contains(o.classes, x))) = 0) = 1 THEN '#' || {esc('c.pid')} || ' > ' || c.own ELSE c.own END AS sel FROM classed c),
anch AS (SELECT page_id, pos, CASE WHEN aid IS NOT NULL THEN CASE WHEN id_n = 1 THEN '#' || {esc('aid')} END
    WHEN attr_n = 1 THEN '[' || stable[1].name || '=' || {quo('stable[1].value')} || ']' END AS anchor FROM (
  SELECT *, (SELECT count(*) FROM el o WHERE o.page_id = x.page_id AND o.id = x.aid) AS id_n,
    (SELECT count(*) FROM flat f WHERE f.page_id = x.page_id AND f.name = x.stable[1].name AND f.raw = x.stable[1].value) AS attr_n
  FROM (SELECT *, CASE WHEN tag <> 'body' AND trim(id) <> '' THEN trim(id) END AS aid FROM el) x WHERE aid IS NOT NULL OR len(stable) > 0)),
nearest AS (SELECT c.page_id, c.pos, max(c.anc) AS near FROM chain c JOIN anch a ON a.page_id = c.page_id AND a.pos = c.anc WHERE c.anc <> c.pos GROUP BY 1, 2),
by_anchor AS (SELECT n.page_id, n.pos, any_value(a.anchor) || ' > ' || string_agg(c.step, ' > ' ORDER BY c.anc) AS sel FROM nearest n
  JOIN anch a ON a.page_id = n.page_id AND a.pos = n.near JOIN chain c ON c.page_id = n.page_id AND c.pos = n.pos AND c.anc > n.near
  JOIN el e ON e.page_id = n.page_id AND e.pos = n.pos AND e.tag NOT IN ('body', 'html') WHERE a.anchor IS NOT NULL GROUP BY 1, 2),
every AS (SELECT 0 AS o, * FROM by_path UNION ALL SELECT 1, * FROM by_anchor UNION ALL SELECT 2, * FROM by_class UNION ALL
  SELECT 3, * FROM by_aria UNION ALL SELECT 4, * FROM by_data UNION ALL SELECT 5, * FROM by_id),
lists AS MATERIALIZED (SELECT e.page_id, e.pos, coalesce(list(y.sel ORDER BY y.o) FILTER (y.sel IS NOT NULL), []) AS sels FROM el e LEFT JOIN every y
  ON y.page_id = e.page_id AND y.pos = e.pos AND e.tag NOT IN ('body', 'html') GROUP BY 1, 2)"""


ROWS = rows(RICH)
for _name, _cte in (("path", "by_path"), ("anchored", "by_anchor"), ("class", "by_class"), ("aria", "by_aria"),
                    ("data", "by_data"), ("id", "by_id")):
    SQL[f"{_name}_selector"] = ROWS + f" SELECT page_id, pos, sel AS selector FROM {_cte}"
SQL["selector_list"] = ROWS + " SELECT page_id, pos, array_to_string(sels, ' || ') AS selectors FROM lists"
SQL["selector_stable"] = ROWS + (
    " SELECT page_id, pos, tag, coalesce(id, '') <> '' OR coalesce(aria, '') <> '' OR len(classes) > 0 OR len(stable) > 0 AS stable FROM el")

CHANGED = f"(SELECT page_id, url, regexp_replace(replace(replace(html, '<article>', '<main><article>'), '<section id', '<div><section id'), '(?s)<nav\\b.*?</nav>', '<p>gone</p>', 'g') AS html FROM {RICH})"


_NAME = r"(?:\\3[0-9] |\\.|[^\s.#>\[\\])+"
_CLASSED = rf"^(?:#({_NAME}) > )?([a-z][a-z0-9-]*)((?:\.{_NAME})+)$"


def _plain(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\\3([0-9]) ', '\1', 'g'), '\\([^0-9])', '\1', 'g')"


# What every element of the changed page answers to, unique or not; classes are matched by their sets.
SQL["selector_restore"] = f"""
WITH a AS MATERIALIZED (SELECT * FROM ({rows(RICH)} SELECT page_id, pos, sels FROM lists)),
b AS MATERIALIZED (SELECT * FROM ({rows(CHANGED)},
  named AS (SELECT page_id, pos, '#' || {esc('id')} AS anchor FROM el WHERE id <> '' UNION ALL
    SELECT page_id, pos, '[' || name || '=' || {quo('raw')} || ']' FROM flat),
  tails AS (SELECT c.page_id, c.pos, a.anc, string_agg(c.step, ' > ' ORDER BY c.anc) AS path FROM chain c
    JOIN (SELECT page_id, pos, unnest(ancestors) AS anc FROM el WHERE tag NOT IN ('body', 'html')) a
    ON a.page_id = c.page_id AND a.pos = c.pos AND c.anc > a.anc GROUP BY 1, 2, 3),
  answers AS (SELECT page_id, pos, sel FROM by_path JOIN el USING (page_id, pos) WHERE tag NOT IN ('body', 'html') UNION ALL
    SELECT t.page_id, t.pos, n.anchor || ' > ' || t.path FROM tails t JOIN named n ON n.page_id = t.page_id AND n.pos = t.anc UNION ALL
    SELECT page_id, pos, tag || '[aria-label=' || {quo('aria')} || ']' FROM el WHERE aria IS NOT NULL UNION ALL
    SELECT page_id, pos, anchor FROM named UNION ALL SELECT page_id, pos, tag || '[' || name || '=' || {quo('raw')} || ']' FROM flat)
  SELECT 'text' AS what, page_id, pos, sel, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS VARCHAR[]) AS classes, CAST(NULL AS VARCHAR) AS pid FROM answers
  UNION ALL SELECT 'classes', c.page_id, c.pos, NULL, c.tag, c.classes, c.pid FROM classed c)),
wanted AS MATERIALIZED (SELECT page_id, pos AS item, unnest(sels) AS sel, unnest(range(0, len(sels))) AS ord FROM a),
asked AS (SELECT page_id, item, ord, {_plain(f"regexp_extract(sel, {q(_CLASSED)}, 1)")} AS under, regexp_extract(sel, {q(_CLASSED)}, 2) AS tag,
  list_transform(regexp_extract_all(regexp_extract(sel, {q(_CLASSED)}, 3), {q(rf"[.]({_NAME})")}, 1), lambda x: {_plain('x')}) AS cs
  FROM wanted WHERE regexp_matches(sel, {q(_CLASSED)})),
hits AS (SELECT w.page_id, w.item, w.ord, b.pos FROM wanted w JOIN b ON b.what = 'text' AND b.page_id = w.page_id AND b.sel = w.sel UNION ALL
  SELECT k.page_id, k.item, k.ord, b.pos FROM asked k JOIN b ON b.what = 'classes' AND b.page_id = k.page_id AND b.tag = k.tag
    AND (k.under = '' OR k.under = b.pid) AND len(list_filter(k.cs, lambda x: NOT list_contains(b.classes, x))) = 0),
once AS (SELECT page_id, item, ord, min(pos) AS found FROM hits GROUP BY 1, 2, 3 HAVING count(*) = 1),
got AS (SELECT page_id, item, arg_min(found, ord) AS found, min(ord) AS by_selector FROM once GROUP BY 1, 2)
SELECT CAST(by_selector AS INT) AS by_selector, count(*) AS items, CAST(sum(found) AS BIGINT) AS checksum FROM got GROUP BY by_selector"""
