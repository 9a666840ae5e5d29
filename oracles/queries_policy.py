"""SQL for settings, rules and saved items."""

from __future__ import annotations

from maskwright import values as V
from maskwright.operators import policy
from maskwright.sources import profiles

from . import queries_pages as QP
from .dialect import has, q

SQL: dict[str, str] = {}
FIELDS = list(policy.DEFAULTS)


def lit(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(v, bool):
        return str(v).lower()
    return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else q(v)


def dflt(name: str) -> str:
    return lit(policy.DEFAULTS[name])


def text(path: str) -> str:
    return f"CASE WHEN json_type(j, '$.{path}') = 'VARCHAR' THEN json_extract_string(j, '$.{path}') END"


def num(path: str) -> str:
    return (f"CASE WHEN json_type(j, '$.{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') "
            f"THEN CAST(json_extract_string(j, '$.{path}') AS DOUBLE) END")


def flag(path: str) -> str:
    return f"CASE WHEN json_type(j, '$.{path}') = 'BOOLEAN' THEN json_extract_string(j, '$.{path}') = 'true' END"


def top(kind, name: str) -> str:
    """A global setting, from the current section or else the older one."""
    return (f"CASE WHEN json_type(j, '$.global_default_settings') = 'OBJECT' "
            f"THEN {kind(f'global_default_settings.{name}')} ELSE {kind(f'settings.{name}')} END")


def ranged(x, lo, hi, name):
    return f"CASE WHEN ({x}) BETWEEN {lo} AND {hi} THEN ({x}) ELSE {dflt(name)} END"


def enum(x, allowed, name, moved=None):
    v = f"({x})"
    if moved:
        v = f"(CASE {v} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in moved.items()) + f" ELSE {v} END)"
    return f"CASE WHEN {v} IN ({', '.join(map(q, allowed))}) THEN {v} ELSE {dflt(name)} END"


def hexa(x, name):
    return f"CASE WHEN {has(f'({x})', V.HEX_COLOR)} THEN ({x}) ELSE {dflt(name)} END"


def opt(x, name):
    return f"coalesce({x}, {dflt(name)})"


def category(name: str) -> str:
    new = flag(f"blur_all.settings.blur_categories.{name}")
    return (f"CASE WHEN json_type(j, '$.blur_all.settings.blur_categories') = 'OBJECT' THEN {opt(new, f'cat_{name}')} "
            f"ELSE {opt(top(flag, f'blur_categories.{name}'), f'cat_{name}')} END")


_unit = enum(text("automate.settings.idle.unit"), V.IDLE_UNITS, "idle_unit")
_value = ranged(num("automate.settings.idle.value"), 1, 99, "idle_value")
_idle = f"CASE WHEN ({_unit}) = 'sec' AND ({_value}) < 15 THEN 15 ELSE ({_value}) END"
VALID = {
    "blur_radius": ranged(top(num, "blur_radius"), 2, 20, "blur_radius"),
    "transition_duration": ranged(top(num, "transition_duration"), 0, 2000, "transition_duration"),
    "highlight_color": hexa(top(text, "highlight_color"), "highlight_color"),
    "redaction_color": hexa(top(text, "redaction_color"), "redaction_color"),
    "reveal_mode": enum(top(text, "reveal_mode"), V.REVEAL_MODES, "reveal_mode"),
    "enabled": opt(top(flag, "enabled"), "enabled"),
    "thorough_blur": opt(top(flag, "thorough_blur"), "thorough_blur"),
    "language": enum(top(text, "language"), V.LANGUAGES, "language"),
    "tab_privacy": opt(top(flag, "tab_privacy"), "tab_privacy"),
    "blur_all_status": opt(flag("blur_all.status"), "blur_all_status"),
    "blur_mode": enum(text("blur_all.settings.blur_mode"), V.BLUR_MODES, "blur_mode", V.BLUR_MODE_MIGRATION),
    **{f"cat_{c}": category(c) for c in policy.CATEGORIES},
    "pick_blur_enabled": opt(flag("pick_and_blur.status"), "pick_blur_enabled"),
    "picker_mode": enum(text("pick_and_blur.settings.picker_mode"), V.PICKER_MODES, "picker_mode",
                        V.PICKER_MODE_MIGRATION),
    "pick_blur_type": enum(text("pick_and_blur.settings.blur_type"), V.PICK_BLUR_MODES, "pick_blur_type",
                           V.BLUR_TYPE_MIGRATION),
    "pick_color_hex": hexa(text("pick_and_blur.settings.blur_color.hex"), "pick_color_hex"),
    "pick_color_opacity": ranged(num("pick_and_blur.settings.blur_color.opacity"), 0, 1, "pick_color_opacity"),
    "pii_email": opt(flag("auto_detect_pii.settings.email"), "pii_email"),
    "pii_numeric": opt(flag("auto_detect_pii.settings.numeric"), "pii_numeric"),
    "pii_mode": enum(text("auto_detect_pii.settings.pii_mode"), V.PII_MODES, "pii_mode", V.PII_MODE_MIGRATION),
    "pii_redaction_color": hexa(text("auto_detect_pii.settings.pii_redaction_color"), "pii_redaction_color"),
    "share_enabled": opt(flag("automate.settings.screen_share.enabled"), "share_enabled"),
    "idle_value": _idle,
    "idle_unit": _unit,
    "idle_enabled": opt(flag("automate.settings.idle.enabled"), "idle_enabled"),
    "tab_switch_enabled": opt(flag("automate.settings.tab_switch.enabled"), "tab_switch_enabled"),
}
LOADED = ("SELECT profile, " + ", ".join(f"{VALID[f]} AS {f}" for f in FIELDS) + " FROM (SELECT profile, "
          "CASE WHEN json_valid(settings) THEN CAST(settings AS JSON) ELSE CAST('{}' AS JSON) END AS j "
          f"FROM ({profiles.PROFILES_SQL}))")
SQL["policy_load"] = LOADED
SQL["policy_export"] = LOADED
SQL["model_validate"] = "WITH l AS (" + LOADED + ") " + " UNION ALL ".join(
    f"SELECT {q(f)} AS field, count_if({f} IS DISTINCT FROM {dflt(f)}) AS changed FROM l" for f in FIELDS)
SQL["model_diff"] = "WITH l AS MATERIALIZED (" + LOADED + ") " + " UNION ALL ".join(
    f"SELECT a.profile, {q(f)} AS field FROM l a JOIN l b ON b.profile + 1 = a.profile "
    f"WHERE a.{f} IS DISTINCT FROM b.{f}" for f in FIELDS)

OFFERED = f"({profiles.RULES_SQL})"
_rest = r"regexp_replace(v, '^(?:(?i:https?)|\*)://', '')"
_bare = f"CASE WHEN starts_with({_rest}, '*.') THEN substring({_rest}, 3) ELSE {_rest} END"


def patterns(src: str) -> str:
    """Rules with their parsed pattern; the value column is ``v``."""
    return f"""(SELECT *, regexp_replace(auth, ':[0-9]+$', '') AS p_host0, lower(regexp_replace(auth, ':[0-9]+$', '')) AS p_host,
      CASE WHEN regexp_matches(auth, ':[0-9]+$') THEN regexp_extract(auth, ':([0-9]+)$', 1) END AS p_port
      FROM (SELECT *, CASE WHEN regexp_matches(v, '^(?i:https?)://') THEN lower(split_part(v, ':', 1)) END AS p_scheme,
        starts_with({_rest}, '*.') AS p_sub, split_part({_bare}, '/', 1) AS auth,
        CASE WHEN contains({_bare}, '/') THEN substring({_bare}, strpos({_bare}, '/')) END AS p_path FROM {src}))"""


SQL["parse_pattern"] = (f"SELECT rule_ord, p_scheme AS scheme, p_host AS host, p_port AS port, p_path AS path, "
                        f"p_sub AS subdomain FROM {patterns(f'(SELECT rule_ord, hostname_value AS v FROM {OFFERED})')}")
RULES = (f"(SELECT rule_ord, left(trim(hostname_value), 500) AS v, CASE WHEN hostname_type IN ('wildcard', 'regex', 'exact') "
         f"THEN hostname_type ELSE 'wildcard' END AS t, snapshot FROM {OFFERED} WHERE trim(hostname_value) <> '' "
         f"ORDER BY rule_ord LIMIT {V.MAX_RULES})")
SQL["rules_normalise"] = f"SELECT rule_ord, v AS hostname_value, t AS hostname_type FROM {RULES}"
PAGES = QP.parts(QP.RICH)

_hosts = f"(SELECT host, count(*) AS pages FROM {PAGES} WHERE host IS NOT NULL GROUP BY host)"
SQL["host_match"] = f"""
WITH h AS {_hosts}, p AS (SELECT DISTINCT regexp_replace(host, '^[^.]*\\.', '') AS pattern FROM h)
SELECT pattern, CAST(sum(pages) AS BIGINT) AS matched, CAST(sum(CASE WHEN host <> pattern THEN pages ELSE 0 END) AS BIGINT) AS below
FROM p JOIN h ON h.host = p.pattern OR ends_with(h.host, '.' || p.pattern) GROUP BY pattern"""


def path_ok(path: str, p: str) -> str:
    return (f"CASE WHEN {p} IS NULL OR {p} IN ('', '/', '/*') THEN true WHEN right({p}, 1) = '*' "
            f"THEN starts_with({path}, left({p}, length({p}) - 1)) ELSE {path} = {p} OR {path} = {p} || '/' END")


_pp = ("CASE page_id % 6 WHEN 0 THEN '/en*' WHEN 1 THEN '/*' WHEN 2 THEN '/fr/825' WHEN 3 THEN '/' "
       "WHEN 4 THEN NULL ELSE '/en/' || page_id END")
SQL["path_match"] = (f"SELECT page_id, {path_ok('path', 'pp')} AS matched FROM (SELECT page_id, path, {_pp} AS pp "
                     f"FROM {PAGES} WHERE path IS NOT NULL)")

_hit = (f"(r.p_scheme IS NULL OR r.p_scheme = p.scheme) AND (CASE WHEN r.p_sub THEN ends_with(p.host, '.' || r.p_host) "
        f"ELSE p.host = r.p_host OR ends_with(p.host, '.' || r.p_host) END) AND (r.p_port IS NULL OR r.p_port = p.port) "
        f"AND {path_ok('p.path', 'r.p_path')}")


def _wild(types: str, rules: str = RULES) -> str:
    return (f"(SELECT p.page_id, min(r.rule_ord) AS rule_ord FROM {PAGES} p LEFT JOIN "
            f"{patterns(f'(SELECT * FROM {rules} WHERE t IN ({types}))')} r ON p.scheme IS NOT NULL AND {_hit} GROUP BY p.page_id)")


WILD = _wild("'wildcard'")
# The safe regex rules are all the well-formed ones of kind 6; the others are unsafe or broken.
REGEX = (f"(SELECT p.page_id, min(r.rule_ord) AS rule_ord FROM {QP.RICH} p LEFT JOIN (SELECT * FROM {RULES} "
         f"WHERE t = 'regex' AND rule_ord % 12 = 6) r ON regexp_matches(regexp_replace(p.url, '#.*$', ''), '(?i)' || r.v) "
         f"GROUP BY p.page_id)")
FILLED = "NOT regexp_matches(snapshot, '^\\s*\\{\\s*\\}\\s*$')"
EXACT = (f"(SELECT p.page_id, min(r.rule_ord) AS rule_ord FROM {PAGES} p LEFT JOIN (SELECT * FROM {RULES} "
         f"WHERE t = 'exact' AND {FILLED}) r ON r.v = p.host GROUP BY p.page_id)")
SQL["rule_match_wildcard"] = f"SELECT * FROM {WILD}"
_all_rules = RULES.replace(OFFERED, f"({profiles.ALL_RULES_SQL})").replace(f" ORDER BY rule_ord LIMIT {V.MAX_RULES}", "")
SQL["rule_index_match"] = f"SELECT * FROM {_wild(repr('wildcard'), _all_rules)}"
SQL["rule_match_regex"] = f"SELECT * FROM {REGEX}"
SQL["rule_match_exact"] = f"SELECT * FROM {EXACT}"
FIRST = f"(SELECT w.page_id, least(w.rule_ord, x.rule_ord) AS rule_ord FROM {WILD} w JOIN {REGEX} x ON x.page_id = w.page_id)"
SQL["first_match"] = f"SELECT * FROM {FIRST}"

_sunit = enum(text("automate.settings.idle.unit"), V.IDLE_UNITS, "idle_unit")
_svalue = ranged(num("automate.settings.idle.value"), 1, 99, "idle_value")
SNAP = {
    "blur_all_status": flag("blur_all.status"),
    "blur_mode": opt(text("blur_all.settings.blur_mode"), "blur_mode"),
    **{f"cat_{c}": opt(flag(f"blur_all.settings.blur_categories.{c}"), f"cat_{c}") for c in policy.CATEGORIES},
    "pick_blur_enabled": opt(flag("pick_and_blur.status"), "pick_blur_enabled"),
    "picker_mode": text("pick_and_blur.settings.picker_mode"),
    "pick_blur_type": opt(text("pick_and_blur.settings.blur_type"), "pick_blur_type"),
    "pick_color_hex": hexa(text("pick_and_blur.settings.blur_color.hex"), "pick_color_hex"),
    "pick_color_opacity": ranged(num("pick_and_blur.settings.blur_color.opacity"), 0, 1, "pick_color_opacity"),
    "pii_email": opt(flag("auto_detect_pii.settings.email"), "pii_email"),
    "pii_numeric": opt(flag("auto_detect_pii.settings.numeric"), "pii_numeric"),
    "pii_mode": enum(text("auto_detect_pii.settings.pii_mode"), V.PII_MODES, "pii_mode"),
    "pii_redaction_color": hexa(text("auto_detect_pii.settings.pii_redaction_color"), "pii_redaction_color"),
    "share_enabled": opt(flag("automate.settings.screen_share.enabled"), "share_enabled"),
    "idle_value": f"CASE WHEN ({_sunit}) = 'sec' AND ({_svalue}) < 15 THEN 15 ELSE ({_svalue}) END",
    "idle_unit": _sunit,
    "idle_enabled": opt(flag("automate.settings.idle.enabled"), "idle_enabled"),
    "tab_switch_enabled": opt(flag("automate.settings.tab_switch.enabled"), "tab_switch_enabled"),
}
_items = "array_to_string(coalesce(json_extract_string(j, '$.pick_and_blur.item_ids[*]'), []), ',')"


def snaps(src: str) -> str:
    cols = ", ".join(f"CASE WHEN NOT is_empty THEN {v} END AS {k}" for k, v in SNAP.items())
    return (f"(SELECT rule_ord, is_empty, {cols}, CASE WHEN NOT is_empty THEN {_items} END AS items FROM (SELECT rule_ord, "
            f"CAST(snapshot AS JSON) AS j, NOT ({FILLED}) AS is_empty FROM {src}))")


SQL["snapshot_complete"] = (
    "SELECT rule_ord, is_empty, blur_all_status, blur_mode, cat_text, cat_form, cat_media, pick_blur_enabled, picker_mode, "
    f"pii_email, pii_numeric, pii_mode, pii_redaction_color, idle_value, idle_unit, items FROM {snaps(OFFERED)}")


def folded(base: dict[str, str]) -> str:
    def pinned(f):
        b = base.get(f, dflt(f))
        if f == "blur_all_status":
            return f"coalesce(e.{f}, s.{f}, {b})"
        if f not in policy.SNAPSHOT_FIELDS:
            return b
        return f"CASE WHEN has_e THEN e.{f} WHEN has_s THEN s.{f} ELSE {b} END"
    cols = ", ".join(f"{pinned(f)} AS {f}" for f in FIELDS)
    has_e, has_s = "(e.rule_ord IS NOT NULL AND NOT e.is_empty)", "(s.rule_ord IS NOT NULL AND NOT s.is_empty)"
    cols = cols.replace("has_e", has_e).replace("has_s", has_s)
    pick = base.get("pick_blur_enabled", dflt("pick_blur_enabled"))
    return f"""(WITH sn AS MATERIALIZED (SELECT * FROM {snaps(RULES)})
    SELECT g.page_id, {cols}, {has_e} AS has_e, {has_s} AS has_s, coalesce(x.rule_ord, f.rule_ord) AS rule_match,
      e.blur_all_status IS NOT NULL OR s.blur_all_status IS NOT NULL AS pins_status,
      CASE WHEN {has_e} THEN CASE WHEN e.pick_blur_enabled THEN e.items ELSE '' END
        WHEN {has_s} THEN CASE WHEN s.pick_blur_enabled THEN s.items ELSE '' END
        WHEN {pick} THEN 'h' || g.page_id ELSE '' END AS items
    FROM pages g JOIN {FIRST} f ON f.page_id = g.page_id JOIN {EXACT} x ON x.page_id = g.page_id
    LEFT JOIN sn s ON s.rule_ord = f.rule_ord LEFT JOIN sn e ON e.rule_ord = x.rule_ord)"""


FOLD = folded({"pick_blur_enabled": "(g.page_id % 2 = 0)"})
SQL["policy_fold"] = f"SELECT page_id, {', '.join(FIELDS)} FROM {FOLD}"
_touched = sorted(("blur_mode", "blur_categories", "pick_blur_enabled", "pick_blur_type", "pick_blur_color", "picker_mode",
                   "blur_items", "pii_email", "pii_numeric", "pii_mode", "pii_redaction_color", "automate_idle",
                   "automate_tab_switch", "automate_screen_share"))
SQL["override_provenance"] = (
    f"SELECT page_id, rule_match, array_to_string(list_sort(list_concat(CASE WHEN pins_status THEN ['blur_all_status'] ELSE [] END, "
    f"CASE WHEN has_e OR has_s THEN {_touched} ELSE [] END)), ',') AS overrides FROM {FOLD}")
SQL["items_replace"] = f"SELECT page_id, items FROM {FOLD}"
SQL["engage_flag"] = (f"SELECT enabled, blur_all_status, enabled AND blur_all_status AS engage, count(*) AS n "
                      f"FROM {FOLD} GROUP BY 1, 2")
_any = f"(SELECT w.page_id, least(w.rule_ord, x.rule_ord) AS rule_ord FROM {_wild(repr('wildcard') + ', ' + repr('exact'))} w JOIN {REGEX} x ON x.page_id = w.page_id)"
#: Settings in a rule, written out: path and type; the rest are the page's globals.
_held = {
    "blur_all_status": ("blur_all.status", "BOOLEAN"), "blur_mode": ("blur_all.settings.blur_mode", "VARCHAR"),
    "cat_text": ("blur_all.settings.blur_categories.text", "BOOLEAN"), "cat_media": ("blur_all.settings.blur_categories.media", "BOOLEAN"),
    "cat_form": ("blur_all.settings.blur_categories.form", "BOOLEAN"), "cat_table": ("blur_all.settings.blur_categories.table", "BOOLEAN"),
    "cat_structure": ("blur_all.settings.blur_categories.structure", "BOOLEAN"), "pick_blur_enabled": ("pick_and_blur.status", "BOOLEAN"),
    "picker_mode": ("pick_and_blur.settings.picker_mode", "VARCHAR"), "pick_blur_type": ("pick_and_blur.settings.blur_type", "VARCHAR"),
    "pick_color_hex": ("pick_and_blur.settings.blur_color.hex", "VARCHAR"),
    "pick_color_opacity": ("pick_and_blur.settings.blur_color.opacity", "DOUBLE"), "pii_email": ("auto_detect_pii.settings.email", "BOOLEAN"),
    "pii_numeric": ("auto_detect_pii.settings.numeric", "BOOLEAN"), "pii_mode": ("auto_detect_pii.settings.pii_mode", "VARCHAR"),
    "pii_redaction_color": ("auto_detect_pii.settings.pii_redaction_color", "VARCHAR"),
    "share_enabled": ("automate.settings.screen_share.enabled", "BOOLEAN"), "idle_value": ("automate.settings.idle.value", "DOUBLE"),
    "idle_unit": ("automate.settings.idle.unit", "VARCHAR"), "idle_enabled": ("automate.settings.idle.enabled", "BOOLEAN"),
    "tab_switch_enabled": ("automate.settings.tab_switch.enabled", "BOOLEAN"),
}
_odd = "(a.page_id % 2 = 1)"
_globals = {
    "blur_radius": "CAST(a.page_id % 25 AS DOUBLE)", "pii_mode": f"CASE WHEN {_odd} THEN 'starred' ELSE 'blur' END", "cat_form": _odd,
    "pii_email": f"(NOT {_odd})", "idle_unit": f"CASE WHEN {_odd} THEN 'sec' ELSE 'min' END",
    "blur_mode": f"CASE WHEN {_odd} THEN 'masked' ELSE 'blur' END",
}


def _laid(field: str) -> str:
    own = _globals.get(field, dflt(field))
    if field not in _held:
        return f"{own} AS {field}"
    path, kind = _held[field]
    return f"coalesce(CAST(json_extract_string(s.j, '$.{path}') AS {kind}), {own}) AS {field}"


SQL["resolve_merge"] = (
    f"SELECT a.page_id, a.rule_ord, {', '.join(_laid(f) for f in FIELDS)} FROM {_any} a "
    f"LEFT JOIN (SELECT rule_ord, CAST(snapshot AS JSON) AS j FROM {RULES}) s ON s.rule_ord = a.rule_ord")

_flags = f"pol AS MATERIALIZED (SELECT page_id, pii_email, pii_numeric FROM {folded({'pii_email': '(g.page_id % 3 = 0)'})})"
_of = f"(SELECT {{}} FROM pol WHERE pol.page_id = id // {QP.NODE})"
SQL["policy_page_scan"] = QP.page_findings(_of.format("pii_email"), _of.format("pii_numeric"), _flags) + (
    " SELECT type, detector, count(*) AS n, count(DISTINCT page_id) AS pages FROM found GROUP BY type, detector")

_valid = f"""coalesce(length(host) > 0 AND CASE type
  WHEN 'dynamic' THEN length(name) <= 100 AND CASE WHEN selectors IS NOT NULL THEN len(selectors) BETWEEN 1 AND 6
    AND len(list_filter(selectors, lambda s: length(s) NOT BETWEEN 1 AND 2000)) = 0 ELSE length(selector) BETWEEN 1 AND 2000 END
  WHEN 'sticky' THEN length(name) <= 100 AND length(id) > 0 AND x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL
    AND height IS NOT NULL END, false)"""
_iid = "CASE WHEN type = 'dynamic' THEN coalesce(selectors[1], selector) ELSE id END"
TAGGED = f"(SELECT *, {_iid} AS item_id, {_valid} AS valid FROM ({profiles.ITEMS_SQL}))"
# Distinct valid ids seen on the host strictly before this save decide whether it is full.
ADMIT = f"""(WITH t AS MATERIALIZED (SELECT * FROM {TAGGED}),
  f AS (SELECT host, item_id, min(seq) AS first_seq FROM t WHERE valid GROUP BY host, item_id)
  SELECT t.seq, t.host, t.item_id, CASE WHEN NOT t.valid THEN 'invalid'
    WHEN (SELECT count(*) FROM f WHERE f.host = t.host AND f.first_seq < t.seq) >= {V.MAX_ITEMS_PER_HOST} THEN 'cap'
    WHEN EXISTS (SELECT 1 FROM f WHERE f.host = t.host AND f.item_id = t.item_id AND f.first_seq < t.seq) THEN 'duplicate'
    END AS reason FROM t)"""
SQL["items_admit"] = f"SELECT seq, host, item_id, reason FROM {ADMIT}"
KEPT = f"(SELECT host, item_id FROM {ADMIT} WHERE reason IS NULL)"
SQL["items_remove"] = (f"SELECT * FROM {KEPT} k WHERE NOT EXISTS (SELECT 1 FROM {TAGGED} g WHERE g.seq % 5 = 0 "
                       f"AND g.host = k.host AND g.item_id = k.item_id)")
SQL["host_clear"] = (f"SELECT * FROM {KEPT} WHERE host NOT IN (SELECT n_nationkey || '.example.com' FROM nation "
                     f"WHERE n_regionkey = 1)")
SQL["items_diff"] = f"""
WITH t AS (SELECT * FROM {TAGGED} WHERE item_id IS NOT NULL)
SELECT host, item_id, CASE WHEN bool_or(seq % 4 <> 2) AND bool_or(seq % 3 <> 1) THEN 'kept'
  WHEN bool_or(seq % 3 <> 1) THEN 'added' ELSE 'removed' END AS change
FROM t WHERE seq % 3 <> 1 OR seq % 4 <> 2 GROUP BY host, item_id"""
