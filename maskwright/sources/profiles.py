"""Settings profiles, site rules, host items and share records derived from driver tables.

Customers become settings profiles and saved items, page hosts become site
rules. All expressions are plain SQL that both engines understand.
"""

from __future__ import annotations

_K = "c_custkey"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _choose(key: str, options) -> str:
    arms = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE ({key}) % {len(options)} {arms} END"


def _bool(key: str) -> str:
    return _choose(key, ("true", "false", "\"yes\"", "null", "true"))


def _obj(*fields: tuple[str, str]) -> str:
    parts = " || ',' || ".join(f"'\"{name}\":' || {value}" for name, value in fields)
    return f"'{{' || {parts} || '}}'"


def _str(expr: str) -> str:
    return f"'\"' || {expr} || '\"'"


_GLOBAL = _obj(
    ("blur_radius", _s(f"{_K} % 25")),
    ("transition_duration", _s(f"{_K} * 37 % 2600")),
    ("highlight_color", _str(_choose(f"{_K} * 3", ("#00ff7F", "red", "#12345", "#abcdef", "#1234567")))),
    ("redaction_color", _str(_choose(f"{_K}", ("#000000", "#FFFFFF", "black")))),
    ("reveal_mode", _str(_choose(f"{_K}", ("none", "click", "hover", "tap")))),
    ("enabled", _bool(_K)),
    ("thorough_blur", _bool(f"{_K} + 1")),
    ("language", _str(_choose(f"{_K}", ("auto", "en", "hi_IN", "ta_IN", "fr", "")))),
    ("tab_privacy", _bool(f"{_K} + 2")),
    ("blur_categories", _obj(("text", _bool(f"{_K} + 3")), ("form", _bool(f"{_K} + 4")))),
)
_BLUR = _obj(
    ("status", _bool(f"{_K} + 1")),
    ("settings", "CASE WHEN c_custkey % 6 = 0 THEN '7' ELSE " + _obj(
        ("blur_mode", _str(_choose(f"{_K}", ("blur", "gaussian", "masked", "solid", "frosted", "redacted", "smear")))),
        ("blur_categories", "CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE " + _obj(
            ("text", _bool(f"{_K}")), ("media", _bool(f"{_K} + 2")), ("form", _bool(f"{_K} + 3")),
            ("table", _bool(f"{_K} + 4"))) + " END"),
    ) + " END"),
)
_PICK = _obj(
    ("status", _bool(f"{_K} + 3")),
    ("settings", _obj(
        ("picker_mode", _choose(f"{_K}", ("null", "\"dynamic\"", "\"sticky\"", "\"sticky-screen\"", "\"lasso\""))),
        ("blur_type", _str(_choose(f"{_K}", ("blur", "gaussian", "color", "censored")))),
        ("blur_color", _obj(
            ("hex", _str(_choose(f"{_K}", ("#0a0B0c", "blue")))),
            ("opacity", _choose(f"{_K}", ("0", "0.5", "1", "1.5", "-1", "\"1\""))))),
    )),
)
_PII = _obj(("settings", _obj(
    ("email", _bool(f"{_K}")),
    ("numeric", _bool(f"{_K} + 1")),
    ("pii_mode", _str(_choose(f"{_K}", ("blur", "asterisked", "hidden", "gaussian", "starred", "redacted", "pixel")))),
    ("pii_redaction_color", _str(_choose(f"{_K}", ("#111111", "#11111g")))),
)))
_AUTO = _obj(("settings", _obj(
    ("screen_share", _obj(("enabled", _bool(f"{_K} + 4")))),
    ("idle", _obj(("value", _s(f"{_K} * 7 % 110")),
                  ("unit", _str(_choose(f"{_K}", ("sec", "min", "hr")))), ("enabled", _bool(f"{_K} + 2")))),
    ("tab_switch", _obj(("enabled", _bool(f"{_K} + 3")))),
)))
_FULL = _obj(
    ("blur_all", _BLUR), ("pick_and_blur", _PICK), ("auto_detect_pii", _PII), ("automate", _AUTO))
SETTINGS_SQL = (
    "CASE WHEN c_custkey % 29 = 7 THEN 'not json' WHEN c_custkey % 29 = 8 THEN '[1,2]' "
    "WHEN c_custkey % 29 = 9 THEN '{}' ELSE "
    "'{' || CASE WHEN c_custkey % 4 = 0 THEN '\"settings\":' ELSE '\"global_default_settings\":' END || "
    f"{_GLOBAL} || ',' || substring({_FULL}, 2, 100000) END"
)
PROFILES_SQL = f"SELECT c_custkey AS profile, {SETTINGS_SQL} AS settings FROM customer"


def profiles(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS profile", f"{SETTINGS_SQL} AS settings")


# Rules: a model holds a fixed number of them, so every page host belongs to one of as many
# groups and the first host of a group names its rule; every kind of rule in turn.
_VALUE = (
    "CASE o % 12 WHEN 0 THEN host WHEN 1 THEN '*.' || parent WHEN 2 THEN host || '/en*' "
    "WHEN 3 THEN 'https://' || host WHEN 4 THEN host || ':8080' WHEN 5 THEN '   ' "
    "WHEN 6 THEN '^https://(www|blog)[.].*/' || CAST(o % 10 AS STRING) || '[0-9]+' "
    "WHEN 7 THEN '(a+)+' || host WHEN 8 THEN '*://' || upper(host) || '/*' "
    "WHEN 9 THEN '  ' || host || '  ' WHEN 10 THEN '[unclosed' ELSE host || '/fr/' || CAST(o AS STRING) END"
)
_TYPE = (
    "CASE o % 12 WHEN 0 THEN 'exact' WHEN 6 THEN 'regex' WHEN 7 THEN 'regex' WHEN 9 THEN 'glob' "
    "WHEN 10 THEN 'regex' ELSE 'wildcard' END"
)


def _ob(key: str) -> str:
    return _choose(key, ("true", "false", "true"))


_SNAPSHOT = (
    "CASE o % 5 WHEN 0 THEN '{}' WHEN 1 THEN " + _obj(
        ("blur_all", _obj(("status", _ob("o")), ("settings", _obj(("blur_mode", _str("'redacted'")))))),
        ("auto_detect_pii", _obj(("settings", _obj(("email", _ob("o + 1")), ("pii_mode", _str("'starred'"))))))) +
    " WHEN 2 THEN " + _obj(
        ("pick_and_blur", _obj(("status", _ob("o")), ("settings", _obj(("picker_mode", _str("'dynamic'")))),
                               ("item_ids", "'[\"p' || CAST(o AS STRING) || '\"]'"))),
        ("automate", _obj(("settings", _obj(("idle", _obj(("value", _s("o % 20")), ("unit", _str("'sec'"))))))))) +
    " WHEN 3 THEN " + _obj(
        ("auto_detect_pii", _obj(("settings", _obj(("numeric", "'true'"), ("pii_mode", _str("'pixel'")),
                                                   ("pii_redaction_color", _str("'#222222'"))))))) +
    " ELSE " + _obj(
        ("blur_all", _obj(("settings", _obj(("blur_categories", _obj(("text", "'false'"), ("form", "'true'"))))))),
        ("pick_and_blur", _obj(("item_ids", "'[]'")))) + " END"
)
HOST = r"^[a-z]+://([^/:?#]+)"
GROUPS = 199
_PARENT = "substring(host, CAST(CASE WHEN instr(host, '.') > 0 THEN instr(host, '.') + 1 ELSE 1 END AS INT), 1000) AS parent"
HOSTS_SQL = (
    f"SELECT o, min(host) AS host, {_PARENT.replace('host', 'min(host)')} FROM (SELECT host, "
    f"CAST(('0x' || substring(md5(host), 1, 7))::INT % {GROUPS} AS INT) AS o FROM "
    "(SELECT regexp_extract(url, '" + HOST + "', 1) AS host FROM pages)) GROUP BY o"
)
RULES_SQL = (f"SELECT o AS rule_ord, {_VALUE} AS hostname_value, {_TYPE} AS hostname_type, "
             f"{_SNAPSHOT} AS snapshot FROM ({HOSTS_SQL})")


# The same rules for every page host: as many as there are hosts, in the order of a hash.
ALL_HOSTS_SQL = (
    f"SELECT CAST(('0x' || substring(md5(host), 1, 7))::INT AS INT) AS o, host, {_PARENT} FROM "
    "(SELECT DISTINCT regexp_extract(url, '" + HOST + "', 1) AS host FROM pages WHERE url IS NOT NULL)"
)
ALL_RULES_SQL = (f"SELECT o AS rule_ord, {_VALUE} AS hostname_value, {_TYPE} AS hostname_type, "
                 f"{_SNAPSHOT} AS snapshot FROM ({ALL_HOSTS_SQL})")


def host_rules(spark, sf_dir: str):
    """A rule of some kind for every page host, without a bound."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hosts = pages.selectExpr(f"regexp_extract(url, r'{HOST}', 1) AS host").where("host is not null").distinct()
    numbered = hosts.selectExpr("CAST(conv(substring(md5(host), 1, 7), 16, 10) AS INT) AS o", "host", _PARENT)
    return numbered.selectExpr("o AS rule_ord", f"{_VALUE} AS hostname_value", f"{_TYPE} AS hostname_type", f"{_SNAPSHOT} AS snapshot")


def site_rules(spark, sf_dir: str):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hosts = pages.selectExpr(f"regexp_extract(url, r'{HOST}', 1) AS host")
    grouped = hosts.selectExpr("host", f"CAST(CAST(conv(substring(md5(host), 1, 7), 16, 10) AS INT) % {GROUPS} AS INT) AS o")
    numbered = grouped.groupBy("o").agg({"host": "min"}).withColumnRenamed("min(host)", "host").selectExpr(
        "o", "host", _PARENT)
    return numbered.selectExpr("o AS rule_ord", f"{_VALUE} AS hostname_value",
                               f"{_TYPE} AS hostname_type", f"{_SNAPSHOT} AS snapshot")


# Saved items: customers save items on a host named after their nation.
_ITEM = (
    "SELECT c_custkey AS seq, CAST(c_nationkey AS STRING) || '.example.com' AS host, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'sticky' WHEN c_custkey % 17 = 5 THEN 'ghost' ELSE 'dynamic' END AS type, "
    "CASE WHEN c_custkey % 19 = 4 THEN CAST(NULL AS STRING) ELSE c_name END AS name, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'z' || CAST(c_custkey % 40 AS STRING) END AS id, "
    "CASE WHEN c_custkey % 3 = 1 THEN 'div.c' || CAST(c_custkey % 50 AS STRING) END AS selector, "
    "CASE WHEN c_custkey % 3 = 2 THEN split('main > p,#i' || CAST(c_custkey % 30 AS STRING), ',') END AS selectors, "
    "CASE WHEN c_custkey % 23 = 3 THEN CAST(NULL AS DOUBLE) ELSE CAST(c_acctbal AS DOUBLE) END AS x, "
    "CAST(10 AS DOUBLE) AS y, CAST(100 AS DOUBLE) AS width, CAST(50 AS DOUBLE) AS height FROM customer"
)
ITEMS_SQL = _ITEM.replace("split(", "string_split(")


def saved_items(spark, sf_dir: str):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    body = _ITEM.removeprefix("SELECT ").removesuffix(" FROM customer")
    columns, depth, start = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0 and body.count("'", 0, i) % 2 == 0:
            columns.append(body[start:i])
            start = i + 1
    columns.append(body[start:])
    return customers.selectExpr(*columns)
