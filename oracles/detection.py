"""Detection stated in SQL: candidates, gates, false-positive rules, claims, merge."""

from __future__ import annotations

from maskwright import values as V
from maskwright.operators import detect

from .dialect import VALIDATORS, has, q, re2, re2_has, secret_value

# Shapes whose look-around is replaced: on text without underscores an ASCII
# word boundary is the same as "no letter or digit on that side".
NO_LOOKAROUND = {
    "card_pan": r"\b(?:\d[ \-]?){11,18}\d\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9 \-]{10,41}(?:[A-Z0-9]\b|[ \-]\B)",
    "ssn_us": r"\b\d{3}-\d{2}-\d{4}\b",
}


def pattern(d: V.Detector) -> str:
    if d.id == "keyword_value":
        return re2(d.pattern, True)
    return re2(NO_LOOKAROUND.get(d.id, d.pattern))


def _gate(d: V.Detector) -> str:
    if d.stage in (1, 2, 3):
        return "regexp_matches(text, '[0-9]')"
    return "contains(text, '@')" if d.stage == 0 else "true"


def hits(src: str, d: V.Detector, rank: int) -> str:
    """Raw matches of one shape over ``src(id, text, country)``."""
    text = "replace(text, '_', ',')" if d.id in ("card_pan", "iban") else "text"
    p = q(pattern(d))
    groups = f"regexp_extract_all({text}, {p}, 1)" if d.id == "keyword_value" else "CAST(NULL AS VARCHAR[])"
    start = ("CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + "
             "coalesce(list_sum(list_transform(hs[1:i-1], lambda x: length(x))), 0) AS INT)")
    body = (f"SELECT id, text, country, {rank} AS rnk, hs[i] AS hit, gs[i] AS val, {start} AS s FROM ("
            f"SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT id, text, country, "
            f"regexp_extract_all({text}, {p}) AS hs, string_split_regex({text}, {p}) AS ps, "
            f"{groups} AS gs FROM {src} WHERE {_gate(d)}))")
    if d.id == "keyword_value":
        quote = "CASE WHEN right(hit, 1) IN ('\"', '''') THEN 1 ELSE 0 END"
        return (f"SELECT id, text, country, rnk, CAST(s + length(hit) - {quote} - length(val) AS INT) AS s, "
                f"val AS hit FROM ({body})")
    return f"SELECT id, text, country, rnk, s, hit FROM ({body})"


def accepted(src: str, d: V.Detector, rank: int) -> str:
    conds = []
    if d.validator:
        conds.append(VALIDATORS[d.validator]("hit"))
    if d.id == "keyword_value":
        conds.append(secret_value("hit"))
    if d.id == "ssn_us":
        conds.append("substring(hit, 1, 3) NOT IN ('000', '666') AND substring(hit, 1, 1) <> '9' "
                     "AND substring(hit, 5, 2) <> '00' AND substring(hit, 8, 4) <> '0000'")
    if not d.dispositive:
        lo = f"greatest(s - {d.window}, 0)"
        near = f"substring(text, {lo} + 1, s + length(hit) + {d.window} - {lo})"
        gate = has(near, d.keyword, True)
        if d.countries:
            gate = f"(coalesce(country IN ({', '.join(q(c) for c in d.countries)}), false) OR {gate})"
        conds.append(gate)
    where = f" WHERE {' AND '.join(conds)}" if conds else ""
    return f"SELECT id, text, country, rnk, s, CAST(s + length(hit) AS INT) AS e, hit FROM ({hits(src, d, rank)}){where}"


def _cut(lo: str, hi: str) -> str:
    return f"substring(text, greatest({lo}, 0) + 1, greatest({hi} - greatest({lo}, 0), 0))"


def rules() -> dict[str, str]:
    """One SQL condition per false-positive rule over ``(text, s, e, hit)``."""
    year = "(?:1[0-9]{3}|20[0-9]{2})"
    shapes = " OR ".join(has("hit", p) for p in V.DATE_SHAPES)
    return {
        "is_year": re2_has("hit", f"^{year}$"),
        "is_version": f"({_cut('s - 1', 's')} IN ('v', 'V') OR {re2_has(_cut('e', 'e + 2'), '^[.][0-9]')})",
        "is_hex_color": f"({_cut('s - 1', 's')} = '#' AND {re2_has('hit', '^[0-9A-Fa-f]+$')} AND length(hit) IN (3, 6, 8))",
        "is_year_range": re2_has("hit", f"^{year}[ \\-–—]{year}$"),
        "is_percentage": f"{_cut('e', 'e + 1')} = '%'",
        "is_scientific": re2_has(_cut("e", "e + 4"), "^(?i)e[+-]?[0-9]"),
        "is_measurement": has(_cut("e", "e + 10"), V.UNIT_TRAIL, True),
        "is_resolution": has(_cut("s - 6", "e + 8"), V.RESOLUTION),
        "is_ordinal_label": has(_cut("s - 30", "s"), V.ORDINAL_PRECURSOR, True),
        "is_date_like": (
            f"({shapes} OR (regexp_matches(hit, '^[0-9]{{8}}$') AND "
            f"TRY_CAST(substring(hit, 5, 2) AS INT) BETWEEN 1 AND 12 AND "
            f"TRY_CAST(substring(hit, 7, 2) AS INT) BETWEEN 1 AND 31) OR (length(hit) <= 10 AND "
            f"{has('hit', V.DATE_SHAPE_FOR_KEYWORD)} AND {has(_cut('s - 50', 'e + 50'), V.DATE_KEYWORD, True)}))"),
        "is_order_ref": has(_cut("s - 50", "s + 50"), V.ORDER_REF, True),
        "is_statistic": has(_cut("s - 30", "s + 30"), V.STATISTIC, True),
        "is_public_price": has(_cut("s - 100", "s + 100"), V.PUBLIC_PRICE, True),
        "is_count_noise": has(_cut("s - 150", "s + 150"), V.COUNT_NOISE, True),
    }


def reason(profile: str = "precise") -> str:
    picked = rules() if profile == "precise" else {"is_version": rules()["is_version"]}
    return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in picked.items()) + " END"


def candidates(src: str, email: str = "true", numeric: str = "true", profile: str = "precise") -> str:
    """Accepted candidates with the reason generic numbers would be dropped for."""
    rows = detect.catalogue()
    generic = len(rows) - 1
    parts = []
    for i, d in enumerate(rows):
        flag = email if i == 0 else numeric
        unit = (f"(SELECT id, text, country FROM {src} WHERE length(text) >= 4 AND ({flag}) AND "
                f"(({email}) OR regexp_matches(text, '[0-9]|[A-Za-z0-9]{{8}}')))")
        why = reason(profile) if i == generic else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT id, rnk, s, e, hit, {why} AS reason FROM ({accepted(unit, d, i)})")
    return " UNION ALL ".join(parts)


def settled(src: str, email: str = "true", numeric: str = "true", profile: str = "precise") -> str:
    """Every candidate with its outcome: ``(id, rnk, s, e, hit, reason, outcome)``."""
    rows = detect.catalogue()
    generic = len(rows) - 1
    silent = ", ".join(str(i) for i, d in enumerate(rows) if d.action == "claim")
    base = (f"CASE WHEN rnk IN ({silent}) THEN 'claimed' WHEN reason IS NOT NULL THEN 'suppressed' "
            f"ELSE 'emitted' END")
    blocked = "(x[1].rnk > 0 AND len(list_filter(acc, lambda a: a.claim AND a.s < x[1].e AND x[1].s < a.e)) > 0)"
    fields = "rnk := {r}.rnk, s := {r}.s, e := {r}.e, hit := {r}.hit, reason := {r}.reason"
    packed = ("struct_pack(rnk := rnk, s := s, e := e, hit := hit, reason := reason, "
              f"outcome := {base}, claim := rnk > 0 AND rnk < {generic})")
    step = (f"struct_pack({fields.format(r='x[1]')}, outcome := CASE WHEN {blocked} THEN 'overlapped' "
            f"ELSE x[1].outcome END, claim := x[1].claim AND NOT {blocked})")
    lost = ("(x[1].outcome = 'emitted' AND len(list_filter(acc, lambda a: a.outcome = 'emitted' "
            "AND a.e > x[1].s)) > 0)")
    merge = (f"struct_pack({fields.format(r='x[1]')}, outcome := CASE WHEN {lost} THEN 'merged' "
             f"ELSE x[1].outcome END, claim := x[1].claim)")
    return (
        f"SELECT id, r.rnk AS rnk, r.s AS s, r.e AS e, r.hit AS hit, r.reason AS reason, r.outcome AS outcome FROM ("
        f"SELECT id, unnest(list_reduce(l2, lambda acc, x: acc || [{merge}])) AS r FROM ("
        f"SELECT id, list([r] ORDER BY r.s, -r.e, r.rnk) AS l2 FROM ("
        f"SELECT id, unnest(list_reduce(l, lambda acc, x: acc || [{step}])) AS r FROM ("
        f"SELECT id, list([{packed}] ORDER BY rnk, s) AS l FROM "
        f"({candidates(src, email, numeric, profile)}) GROUP BY id)) GROUP BY id))")


def _name() -> str:
    return "[" + ", ".join(q(d.id) for d in detect.catalogue()) + "][rnk + 1]"


def findings(src: str, **kw) -> str:
    """``(id, start, end, type, detector, text)`` of the emitted findings."""
    return (f"SELECT id, s AS start_pos, e AS end_pos, CASE WHEN rnk = 0 THEN 'email' ELSE 'numeric' END AS type, "
            f"{_name()} AS detector, hit FROM ({settled(src, **kw)}) WHERE outcome = 'emitted'")


DOCS = "(SELECT doc_id AS id, text, CAST(NULL AS VARCHAR) AS country FROM documents)"
CONV = "(SELECT conv_id * 100000 + turn AS id, text, CAST(NULL AS VARCHAR) AS country FROM conversations)"
