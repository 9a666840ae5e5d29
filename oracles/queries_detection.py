"""SQL for the text-unit queries."""

from __future__ import annotations

from maskwright import values as V
from maskwright.operators import detect
from maskwright.sources import probes

from . import detection as D
from . import dialect as S
from .dialect import has, q, re2

SQL: dict[str, str] = {}
CAT = detect.catalogue()
GENERIC = len(CAT) - 1
UNITS = (f"(SELECT 'doc' AS src, doc_id AS id, text, CAST(NULL AS VARCHAR) AS country FROM documents "
         f"UNION ALL SELECT 'probe', id, text, country FROM ({probes.SELECT_SQL}))")
PROBES = f"({probes.SELECT_SQL})"
# Documents and probes share keys, so the source is folded into the key and split off again.
KEYED = ("(SELECT CASE WHEN src = 'doc' THEN id ELSE -1 - id END AS id, text, country FROM " + UNITS + ")")
SRC = "CASE WHEN id >= 0 THEN 'doc' ELSE 'probe' END AS src, CASE WHEN id >= 0 THEN id ELSE -1 - id END AS id"
NAME = "[" + ", ".join(q(d.id) for d in CAT) + "][rnk + 1]"
DIGIT = "regexp_matches(text, '[0-9]')"
LONG = "regexp_matches(text, '[0-9]|[A-Za-z0-9]{8}')"

SQL["scan_text"] = ("SELECT 'documents' AS src, doc_id AS id, length(text) AS n_chars FROM documents UNION ALL "
                    "SELECT 'conversations', conv_id * 100000 + turn, length(text) FROM conversations")
SQL["prescreens"] = f"""
SELECT src, count(*) AS units, count_if(length(text) >= 4) AS min_len, count_if({DIGIT}) AS has_digit,
  count_if({LONG}) AS has_digit_or_long_alnum, count_if(contains(text, '@')) AS has_at,
  count_if(length(text) >= 4) AS scan_both, count_if(length(text) >= 4 AND {LONG}) AS scan_numeric,
  CAST(0 AS BIGINT) AS scan_none FROM {UNITS} GROUP BY src"""


def _gate(d):
    if d.gate:
        return has("text", d.gate)
    return "(" + " OR ".join(f"contains(text, {q(w)})" for w in d.contains) + ")"


_rows = [d for d in CAT if d.stage in (1, 2)]
SQL["detector_prescreen"] = " UNION ALL ".join(
    f"SELECT {q(d.id)} AS detector, count_if({_gate(d)}) AS units FROM {UNITS} WHERE {DIGIT}" for d in _rows)
SQL["min_len"] = "SELECT conv_id * 100000 + turn AS id FROM conversations WHERE length(text) >= 4"
SQL["has_digit"] = f"SELECT src, id FROM {UNITS} WHERE {DIGIT}"
SQL["has_digit_or_long_alnum"] = f"SELECT src, id FROM {UNITS} WHERE {LONG}"
SQL["has_at"] = f"SELECT src, id FROM {UNITS} WHERE contains(text, '@')"
SQL["detectors"] = " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS rank, {q(d.id)} AS detector, CAST({d.stage} AS INT) AS stage, {q(d.action)} AS action, "
    f"{q(d.validator) if d.validator else 'CAST(NULL AS VARCHAR)'} AS validator, "
    + (f"(SELECT count(*) FROM {UNITS} WHERE country IN ({', '.join(map(q, d.countries))})) AS trusted_units"
       if d.countries else "CAST(0 AS BIGINT) AS trusted_units")
    for i, d in enumerate(CAT))

for _i, _d in enumerate(CAT):
    if _d.id != "numeric_generic":
        SQL[f"detect_{_d.id}"] = (
            f"SELECT {SRC}, s AS start_pos, e AS end_pos, hit FROM ({D.accepted(KEYED, _d, _i)})")

_alts = " ".join(f"WHEN regexp_full_match(hit, {q(re2(p))}) THEN {q(n)}" for n, p in V.NUMERIC_ALTERNATIVES)
SQL["numeric_generic"] = (
    f"SELECT {SRC}, s AS start_pos, hit, {D.reason()} AS reason, CASE {_alts} ELSE 'other' END AS alternative "
    f"FROM ({D.accepted(KEYED, CAT[GENERIC], GENERIC)})")
_kv = q(D.pattern(next(d for d in CAT if d.id == "keyword_value")))
SQL["secret_value_ok"] = (
    f"SELECT src, id, value, {S.secret_value('value')} AS ok FROM (SELECT src, id, "
    f"unnest(regexp_extract_all(text, {_kv}, 1)) AS value FROM {UNITS})")

RUNS = f"(SELECT src, id, unnest(regexp_extract_all(text, '[0-9]+[Xx]?')) AS s FROM {UNITS})"
for _name, _check in (("luhn_ok", S.luhn), ("verhoeff_ok", S.verhoeff), ("iso7064_11_2_ok", S.iso7064),
                      ("isbn13_ok", S.isbn13), ("isbn10_ok", S.isbn10)):
    SQL[_name] = (f"SELECT CAST(length(s) AS INT) AS len, count(*) AS n, count_if({_check('s')}) AS valid "
                  f"FROM {RUNS} GROUP BY 1")
SQL["mod97_ok"] = (
    f"SELECT src, id, s, {S.mod97('s')} AS mod97, {S.iban_len('substring(s, 1, 2)')} AS expected_len FROM ("
    f"SELECT src, id, unnest(regexp_extract_all({S.digits('text')}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{6,30}}')) AS s FROM {UNITS})")
SQL["mod11_weighted"] = (f"SELECT {S.mod11('d', V.NHS_WEIGHTS)} AS residue, count(*) AS n "
                         f"FROM (SELECT s AS d FROM {RUNS}) GROUP BY 1")
SQL["card_network"] = (f"SELECT {S.network('s')} AS network, count(*) AS n, count_if({S.luhn('s')}) AS luhn "
                       f"FROM {RUNS} WHERE length(s) BETWEEN 12 AND 20 GROUP BY 1")
SQL["iban_country_len"] = (
    f"SELECT code, count(*) AS n, max({S.iban_len('code')}) AS iban_len FROM (SELECT "
    f"unnest(regexp_extract_all(text, '([A-Z]{{2}})[0-9]{{2}}', 1)) AS code FROM {UNITS}) GROUP BY code")
_octets = "list_transform(string_split(ip, '.'), lambda o: CAST(o AS INT))"
SQL["ipv4_public"] = (
    f"SELECT src, id, ip, ({S.ipv4('ip')} AND list_max({_octets}) <= 255) AS public FROM ("
    f"SELECT src, id, unnest(regexp_extract_all(text, '[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}')) AS ip FROM {UNITS})")
SQL["strip_separators"] = (
    f"SELECT src, id, raw, {S.digits('raw')} AS digits FROM (SELECT src, id, "
    f"unnest(regexp_extract_all(text, '[0-9][0-9 -]+[0-9]')) AS raw FROM {UNITS})")

_context = [(i, d) for i, d in enumerate(CAT) if not d.dispositive]


def _shape(d):
    """A shape before its gates; the look-around of one shape is restated on its parts."""
    if d.id != "ssn_us":
        return "true"
    return ("substring(hit, 1, 3) NOT IN ('000', '666') AND substring(hit, 1, 1) <> '9' "
            "AND substring(hit, 5, 2) <> '00' AND substring(hit, 8, 4) <> '0000'")


def _near(d):
    lo = f"greatest(s - {d.window}, 0)"
    return has(f"substring(text, {lo} + 1, s + length(hit) + {d.window} - {lo})", d.keyword, True)


SQL["keyword_window"] = " UNION ALL ".join(
    f"SELECT {SRC}, {q(d.id)} AS detector, s AS start_pos, hit, {_near(d)} AS keyword "
    f"FROM ({D.hits(KEYED, d, i)}) WHERE {_shape(d)} AND {_gate(d)}" for i, d in _context)
SQL["country_gate"] = " UNION ALL ".join(
    f"SELECT {q(d.id)} AS detector, country, count(*) AS n FROM ({D.hits(KEYED, d, i)}) WHERE {_shape(d)} "
    f"AND {_gate(d)} AND country IN ({', '.join(map(q, d.countries))}) GROUP BY country"
    for i, d in _context if d.countries)


def _decided(d):
    if d.dispositive:
        return "'checksum'" if d.validator else "'shape'"
    if not d.countries:
        return "'keyword'"
    return f"CASE WHEN coalesce(country IN ({', '.join(map(q, d.countries))}), false) THEN 'country' ELSE 'keyword' END"


SQL["gate_order"] = " UNION ALL ".join(
    f"SELECT {q(d.id)} AS detector, {_decided(d)} AS decided_by, count(*) AS n FROM ({D.accepted(KEYED, d, i)}) GROUP BY 1, 2"
    for i, d in enumerate(CAT) if d.stage in (1, 2))

_g = D.accepted(KEYED, CAT[GENERIC], GENERIC)
SQL["suppressors"] = (f"SELECT {SRC}, s AS start_pos, hit, "
                      + ", ".join(f"{cond} AS {name}" for name, cond in D.rules().items()) + f" FROM ({_g})")
for _name, _cond in D.rules().items():
    SQL[_name] = f"SELECT {SRC}, s AS start_pos, hit FROM ({_g}) WHERE {_cond}"
for _name, _ in V.NUMERIC_ALTERNATIVES:
    SQL[_name] = f"SELECT src, id, start_pos, hit, reason FROM ({SQL['numeric_generic']}) WHERE alternative = {q(_name)}"
SQL["suppress_reason"] = (f"SELECT src, reason, count(*) AS n FROM (SELECT {SRC}, {D.reason()} AS reason FROM ({_g})) "
                          f"GROUP BY src, reason")


def findings(src: str, **kw) -> str:
    return D.findings(src, **kw)


SQL["scan"] = findings(D.DOCS)
SQL["scan_aggressive"] = findings(D.DOCS, profile="aggressive")
SQL["scan_conversations"] = findings(D.CONV)
SQL["scan_probes"] = findings(PROBES)
SQL["findings_sink"] = SQL["pii_scan"] = SQL["scan"]
SQL["priority_claim"] = (f"SELECT id, CAST(rnk AS INT) AS rank, s AS start_pos, e AS end_pos, hit, reason, outcome "
                         f"FROM ({D.settled(PROBES)})")
_all = findings(KEYED)
SQL["final_merge"] = (f"SELECT {SRC}, count(*) AS n, sum(end_pos - start_pos) AS covered, min(start_pos) AS first_start, "
                      f"max(end_pos) AS last_end FROM ({_all}) GROUP BY id")
_gated = (f"SELECT {SRC.replace(' AS src', ' AS src_').replace(' AS id', ' AS key')}, type FROM "
          f"({findings(KEYED, email='(CASE WHEN id >= 0 THEN id ELSE -1 - id END) % 2 = 0', numeric='(CASE WHEN id >= 0 THEN id ELSE -1 - id END) % 3 = 0')})")
SQL["type_gate"] = (f"SELECT src_ AS src, key % 2 = 0 AS email_on, key % 3 = 0 AS numeric_on, type, count(*) AS n "
                    f"FROM ({_gated}) GROUP BY 1, 2, 3, 4")
SQL["match_count"] = (f"SELECT d.doc_id AS id, count(f.id) AS n FROM documents d LEFT JOIN ({SQL['scan']}) f "
                      f"ON f.id = d.doc_id GROUP BY d.doc_id")
SQL["scan_stats"] = f"""
SELECT src, node_count, digit_node_count, stage3_candidates, stage4_suppressed, total_emit
FROM (SELECT src, count(*) AS node_count, count_if({DIGIT}) AS digit_node_count FROM {UNITS}
      WHERE length(text) >= 4 GROUP BY src)
JOIN (SELECT CASE WHEN id >= 0 THEN 'doc' ELSE 'probe' END AS src, count_if(rnk = {GENERIC}) AS stage3_candidates,
        count_if(rnk = {GENERIC} AND outcome IN ('overlapped', 'suppressed')) AS stage4_suppressed,
        count_if(outcome IN ('emitted', 'merged')) AS total_emit
      FROM ({D.settled(KEYED)}) GROUP BY 1) USING (src)"""
_docs = f"(SELECT d.lang, d.source, f.* FROM ({SQL['scan']}) f JOIN documents d ON d.doc_id = f.id)"
SQL["findings_rollup"] = (f"SELECT source, lang, detector, count(*) AS n, CAST(grouping(source, lang, detector) AS INT) AS level "
                          f"FROM {_docs} GROUP BY ROLLUP (source, lang, detector)")
SQL["findings_cube"] = (f"SELECT lang, type, count(*) AS n, sum(end_pos - start_pos) AS chars FROM {_docs} "
                        f"GROUP BY CUBE (lang, type)")
SQL["distinct_values"] = (f"SELECT detector, count(*) AS findings, count(DISTINCT hit) AS distinct_values "
                          f"FROM ({_all}) GROUP BY detector")
SQL["distinct_values_sketch"] = (f"SELECT detector, count(*) AS findings, count(DISTINCT hit) AS distinct_values, true AS near "
                                 f"FROM ({SQL['scan_probes']}) GROUP BY detector")
SQL["findings_by_quality"] = (f"SELECT quality, toxic, count(*) AS docs, sum(n) AS findings FROM ({SQL['match_count']}) m "
                              f"JOIN labels l ON l.doc_id = m.id GROUP BY quality, toxic")


def rendered(src: str, piece: str, where: str = "len(ms) > 0") -> str:
    """Units with findings rebuilt: ``piece`` renders one finding ``m``."""
    last = "CASE WHEN i > 1 THEN ms[i - 1].e ELSE 0 END"
    body = (f"array_to_string(list_transform(range(1, len(ms) + 1), lambda i: "
            f"substring(text, {last} + 1, ms[i].s - {last}) || {piece}), '') || substring(text, ms[-1].e + 1)")
    return (f"SELECT id, text, CASE WHEN len(ms) > 0 THEN {body} ELSE text END AS masked FROM (SELECT u.id, u.text, "
            f"coalesce(g.ms, []) AS ms FROM {src} u LEFT JOIN (SELECT id, list(struct_pack(s := start_pos, e := end_pos, "
            f"t := type, h := hit) ORDER BY start_pos) AS ms FROM ({findings(src)}) GROUP BY id) g ON g.id = u.id) WHERE {where}")


def _fill(glyph):
    return f"repeat('{glyph}', ms[i].e - ms[i].s)"


SPAN = "'<span data-pii=\"' || ms[i].t || '\">' || ms[i].h || '</span>'"
for _name, _piece in (("mask_starred", _fill("*")), ("mask_redacted", _fill("█")), ("mask_censored", _fill("●")),
                      ("annotate_spans", SPAN)):
    SQL[_name] = (f"SELECT {SRC}, md5(masked) AS masked_md5, CAST(length(masked) AS INT) AS n_chars "
                  f"FROM ({rendered(KEYED, _piece)})")
SQL["unmask"] = f"SELECT src, id, md5(text) AS text_md5 FROM {UNITS}"
_outside = (f"SELECT id, unnest(string_split_regex(masked, '<span data-pii=\"[a-z]+\">(?s:.*?)</span>')) AS outside, "
            f"unnest(range(0, len(string_split_regex(masked, '<span data-pii=\"[a-z]+\">(?s:.*?)</span>')))) AS part "
            f"FROM ({rendered(KEYED, SPAN)})")
SQL["skip_already_masked"] = (f"SELECT {SRC}, CAST(part AS INT) AS part, CAST(length(outside) AS INT) AS n_chars, "
                              f"md5(outside) AS md5 FROM ({_outside})")
SQL["masked_sink"] = SQL["pii_mask"] = f"SELECT id, md5(masked) AS masked_md5 FROM ({rendered(D.DOCS, _fill('*'), 'true')})"

_ranges = ("(SELECT page_id, 'a' AS range_id, 5 AS lo0, 40 AS hi0 FROM k UNION ALL SELECT page_id, 'b', "
           "100 + page_id % 50, 700 + page_id % 90 FROM k UNION ALL SELECT page_id, 'c', 60, 60 FROM k)")
_clip = """WITH k AS (SELECT DISTINCT conv_id AS page_id FROM conversations),
n AS (SELECT conv_id AS page_id, turn AS node_id, text, length(text) AS len,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS BIGINT) AS off FROM conversations),
r AS (SELECT n.page_id, n.node_id, r.range_id, n.text, CAST(greatest(r.lo0 - off, 0) AS INT) AS lo,
  CAST(least(r.hi0 - off, len) AS INT) AS hi FROM n JOIN """ + _ranges + """ r ON r.page_id = n.page_id
  AND r.lo0 < off + len AND r.hi0 > off)
"""
SQL["mask_range"] = _clip + ("SELECT page_id, node_id, range_id, lo, hi, md5(substring(text, 1, lo) || "
                             "repeat('*', hi - lo) || substring(text, hi + 1)) AS masked_md5 FROM r WHERE lo < hi")
SQL["remove_mask_range"] = _clip + ("SELECT page_id, node_id, range_id, lo, hi FROM r WHERE lo < hi "
                                    "AND NOT (range_id = 'a' OR page_id % 4 = 0)")
