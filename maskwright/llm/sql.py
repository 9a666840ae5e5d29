"""DuckDB statements that say what the queries must return."""

from __future__ import annotations

SQL: dict[str, str] = {}

#: Rows that several documents may share an id with keep their own row number here.
SQL["op3_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM d),
lines AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM parts),
keyed AS (SELECT r, doc_id, pos, line,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT r, doc_id, pos, line, holder IS NOT NULL AND doc_id IS DISTINCT FROM holder AS gone
  FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

#: Pages of the given tables declare one article of h1 and p blocks.
SQL["op1_site_templates"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
blocks AS (SELECT page_id, url, regexp_split_to_array(body, '</?(p|h1)>') AS bs FROM a),
plain AS (SELECT page_id, url, [trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
  '\s+', ' ', 'g')) FOR b IN bs] AS bs FROM blocks),
texts AS (SELECT page_id, url, coalesce(array_to_string([b FOR b IN bs IF b <> ''], chr(10)), '') AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""

SQL["op4_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1),
marked AS (SELECT p.*, CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AND payload_bytes >= 1000
  THEN keeper END AS refers_to FROM p LEFT JOIN last USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  refers_to FROM marked
"""


def link_trust(rounds: int = 12, damping: float = 0.85) -> str:
    """Rules by length, then the rounds of both walks written out one after the other."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))"
    rules = (("allow", "www.example.com", "/en/"), ("block", "example.com", "/en/"), ("block", "net", "/es/"),
             ("block", "net", "/fr/"), ("allow", "com", "/"))
    rule = " ".join(f"WHEN {fits.format(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    verdict = " ".join(f"WHEN {fits.format(h, p)} THEN '{v}'" for v, h, p in rules)
    steps = []
    for k in range(rounds):
        steps.append(f"""s{k + 1} AS (SELECT kind, host, sum(score) AS score FROM (
  SELECT w.kind, w.b AS host, {damping} * w.w * s.score AS score FROM ways w JOIN s{k} s ON w.kind = s.kind AND w.a = s.host
  UNION ALL SELECT kind, host, score FROM s0) GROUP BY kind, host)""")
    return f"""
WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, {lower.format("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM parts),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^<>]*?href\\s*=\\s*["'']?([^"''\\s<>]+)', 1)) AS href
  FROM ruled WHERE host <> ''),
hosts AS (SELECT src, {lower.format("regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)', 1)")} AS dst FROM links),
edges AS (SELECT src, dst, count(*) AS n FROM hosts WHERE dst <> '' AND dst <> src GROUP BY src, dst),
both_ways AS (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
ways AS (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS w FROM both_ways),
shares AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS d
  FROM ruled WHERE host <> '' GROUP BY host),
s0 AS (SELECT 'trust' AS kind, host, {1 - damping} AS score FROM shares WHERE t >= 0.5
  UNION ALL SELECT 'distrust', host, {1 - damping} FROM shares WHERE d >= 0.5),
{", ".join(steps)},
by_host AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS d, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS t
  FROM s{rounds} GROUP BY host),
bad AS (SELECT host FROM by_host WHERE d >= 0.01 AND d >= 0.5 * (d + t))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


SQL["op5_link_trust"] = link_trust()

SQL["op8_jaccard_join"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
lists AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM lists),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9 GROUP BY ALL),
linked AS (SELECT a, b FROM pairs WHERE 100 * i >= 90 * (na + nb - i)),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM lists LEFT JOIN least_of ON doc_id = a
"""

#: Every step of every order counted anew from the documents by what they fail.
SQL["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(ws) < 50)::INT
    + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(l, bit)),
orders AS (SELECT [a, b, c, d, e] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
plan AS (SELECT list_aggregate([x.l FOR x IN o], 'string_agg', '') AS filter_order, step, o[step].bit AS bit,
  coalesce(list_sum([x.bit FOR x IN o[1:step - 1]]), 0)::INT AS before FROM orders, range(1, 6) AS r(step)),
counted AS (SELECT part, filter_order, step::INT AS step, bit,
  coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM cells, plan GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""

SQL["op12_ranked_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
sizes AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
held AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
counted AS (SELECT r, doc_id, n, t, count(*) AS tf FROM held GROUP BY r, doc_id, n, t),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, sizes GROUP BY t, n_docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scored AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN counted USING (t), sizes GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
