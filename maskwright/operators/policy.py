"""Settings repair, site rules and their fold into one policy per page."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import url as U
from ..functions.arrays import let, with_once
from ..functions.rx import ecmascript, java

_CATS = "struct<text:boolean,media:boolean,form:boolean,table:boolean,structure:boolean>"
_GLOBAL = ("struct<blur_radius:double,transition_duration:double,highlight_color:string,"
           "redaction_color:string,reveal_mode:string,enabled:boolean,thorough_blur:boolean,"
           f"language:string,tab_privacy:boolean,blur_categories:{_CATS}>")
_COLOR = "struct<hex:string,opacity:double>"
_BLUR_ALL = f"struct<status:boolean,settings:struct<blur_mode:string,blur_categories:{_CATS}>>"
_PICK = ("struct<status:boolean,settings:struct<picker_mode:string,blur_type:string,"
         f"blur_color:{_COLOR}>,item_ids:array<string>>")
_PII = ("struct<settings:struct<email:boolean,numeric:boolean,pii_mode:string,"
        "pii_redaction_color:string>>")
_AUTO = ("struct<settings:struct<screen_share:struct<enabled:boolean>,"
         "idle:struct<value:double,unit:string,enabled:boolean>,tab_switch:struct<enabled:boolean>>>")
RAW_SETTINGS = (f"struct<global_default_settings:{_GLOBAL},settings:{_GLOBAL},blur_all:{_BLUR_ALL},"
                f"pick_and_blur:{_PICK},auto_detect_pii:{_PII},automate:{_AUTO}>")
RAW_SNAPSHOT = (f"struct<blur_all:{_BLUR_ALL},pick_and_blur:{_PICK},auto_detect_pii:{_PII},"
                f"automate:{_AUTO}>")

# The default of every setting.
DEFAULTS = {
    "blur_radius": 8.0, "transition_duration": 300.0, "highlight_color": "#f59e0b",
    "redaction_color": "#000000", "reveal_mode": "hover", "enabled": True, "thorough_blur": False,
    "language": "auto", "tab_privacy": False,
    "blur_all_status": False, "blur_mode": "blur",
    "cat_text": True, "cat_media": True, "cat_form": False, "cat_table": True, "cat_structure": True,
    "pick_blur_enabled": False, "picker_mode": None, "pick_blur_type": "blur",
    "pick_color_hex": "#000000", "pick_color_opacity": 1.0,
    "pii_email": False, "pii_numeric": False, "pii_mode": "blur", "pii_redaction_color": "#000000",
    "share_enabled": True, "idle_value": 5.0, "idle_unit": "min", "idle_enabled": False,
    "tab_switch_enabled": False,
}
CATEGORIES = ("text", "media", "form", "table", "structure")


def _default(name: str) -> Column:
    value = DEFAULTS[name]
    return F.lit(value) if value is not None else F.lit(None).cast("string")


def _ranged(x: Column, lo, hi, name: str) -> Column:
    return F.when(x.between(lo, hi), x).otherwise(_default(name))


def _hex(x: Column, name: str) -> Column:
    return F.when(x.rlike(java(V.HEX_COLOR).replace("^", r"\A", 1)), x).otherwise(_default(name))


def _migrate(x: Column, table: dict[str, str]) -> Column:
    moved = x
    for old, new in table.items():
        moved = F.when(x == old, new).otherwise(moved)
    return moved


def _enum(x: Column, allowed, name: str) -> Column:
    return F.when(x.isin(*allowed), x).otherwise(_default(name))


def _flag(x: Column, name: str) -> Column:
    return F.coalesce(x, _default(name))


def _idle_value(value: Column, unit: Column) -> Column:
    return F.when((unit == "sec") & (value < V.IDLE_MIN_SECONDS), float(V.IDLE_MIN_SECONDS)).otherwise(value)


def validate(raw: Column) -> dict[str, Column]:
    """Every setting of a parsed model, repaired: bad or missing values become defaults."""
    top = F.coalesce(raw["global_default_settings"], raw["settings"])
    blur, pick = raw["blur_all"], raw["pick_and_blur"]
    pii, auto = raw["auto_detect_pii"]["settings"], raw["automate"]["settings"]
    cats = F.coalesce(blur["settings"]["blur_categories"], top["blur_categories"])
    unit = _enum(auto["idle"]["unit"], V.IDLE_UNITS, "idle_unit")
    out = {
        "blur_radius": _ranged(top["blur_radius"], 2, 20, "blur_radius"),
        "transition_duration": _ranged(top["transition_duration"], 0, 2000, "transition_duration"),
        "highlight_color": _hex(top["highlight_color"], "highlight_color"),
        "redaction_color": _hex(top["redaction_color"], "redaction_color"),
        "reveal_mode": _enum(top["reveal_mode"], V.REVEAL_MODES, "reveal_mode"),
        "enabled": _flag(top["enabled"], "enabled"),
        "thorough_blur": _flag(top["thorough_blur"], "thorough_blur"),
        "language": _enum(top["language"], V.LANGUAGES, "language"),
        "tab_privacy": _flag(top["tab_privacy"], "tab_privacy"),
        "blur_all_status": _flag(blur["status"], "blur_all_status"),
        "blur_mode": _enum(_migrate(blur["settings"]["blur_mode"], V.BLUR_MODE_MIGRATION),
                           V.BLUR_MODES, "blur_mode"),
        **{f"cat_{c}": _flag(cats[c], f"cat_{c}") for c in CATEGORIES},
        "pick_blur_enabled": _flag(pick["status"], "pick_blur_enabled"),
        "picker_mode": _enum(_migrate(pick["settings"]["picker_mode"], V.PICKER_MODE_MIGRATION),
                             V.PICKER_MODES, "picker_mode"),
        "pick_blur_type": _enum(_migrate(pick["settings"]["blur_type"], V.BLUR_TYPE_MIGRATION),
                                V.PICK_BLUR_MODES, "pick_blur_type"),
        "pick_color_hex": _hex(pick["settings"]["blur_color"]["hex"], "pick_color_hex"),
        "pick_color_opacity": _ranged(pick["settings"]["blur_color"]["opacity"], 0, 1,
                                      "pick_color_opacity"),
        "pii_email": _flag(pii["email"], "pii_email"),
        "pii_numeric": _flag(pii["numeric"], "pii_numeric"),
        "pii_mode": _enum(_migrate(pii["pii_mode"], V.PII_MODE_MIGRATION), V.PII_MODES, "pii_mode"),
        "pii_redaction_color": _hex(pii["pii_redaction_color"], "pii_redaction_color"),
        "share_enabled": _flag(auto["screen_share"]["enabled"], "share_enabled"),
        "idle_value": _idle_value(_ranged(auto["idle"]["value"], 1, 99, "idle_value"), unit),
        "idle_unit": unit,
        "idle_enabled": _flag(auto["idle"]["enabled"], "idle_enabled"),
        "tab_switch_enabled": _flag(auto["tab_switch"]["enabled"], "tab_switch_enabled"),
    }
    return out


def load(df: DataFrame, column: str = "settings") -> DataFrame:
    """Settings JSON to one column per setting."""
    parsed = df.withColumn("_raw", F.from_json(column, RAW_SETTINGS))
    keep = [c for c in df.columns if c != column]
    return parsed.select(*keep, *[c.alias(n) for n, c in validate(F.col("_raw")).items()])


def export(df: DataFrame) -> Column:
    """A repaired model back to JSON text."""
    col = F.col
    return F.to_json(F.struct(
        F.struct(*[col(n) for n in ("blur_radius", "transition_duration", "highlight_color",
                                    "redaction_color", "reveal_mode", "enabled", "thorough_blur",
                                    "language", "tab_privacy")]).alias("global_default_settings"),
        F.struct(col("blur_all_status").alias("status"), F.struct(
            col("blur_mode"), F.struct(*[col(f"cat_{c}").alias(c) for c in CATEGORIES])
            .alias("blur_categories")).alias("settings")).alias("blur_all"),
        F.struct(col("pick_blur_enabled").alias("status"), F.struct(
            col("picker_mode"), col("pick_blur_type").alias("blur_type"),
            F.struct(col("pick_color_hex").alias("hex"), col("pick_color_opacity").alias("opacity"))
            .alias("blur_color")).alias("settings")).alias("pick_and_blur"),
        F.struct(F.struct(col("pii_email").alias("email"), col("pii_numeric").alias("numeric"),
                          col("pii_mode"), col("pii_redaction_color")).alias("settings"))
        .alias("auto_detect_pii"),
        F.struct(F.struct(
            F.struct(col("share_enabled").alias("enabled")).alias("screen_share"),
            F.struct(col("idle_value").alias("value"), col("idle_unit").alias("unit"),
                     col("idle_enabled").alias("enabled")).alias("idle"),
            F.struct(col("tab_switch_enabled").alias("enabled")).alias("tab_switch"),
        ).alias("settings")).alias("automate")), {"ignoreNullFields": "false"})


# ---------------------------------------------------------------- snapshots

SNAPSHOT_FIELDS = ("blur_mode", *(f"cat_{c}" for c in CATEGORIES), "pick_blur_enabled",
                   "picker_mode", "pick_blur_type", "pick_color_hex", "pick_color_opacity",
                   "pii_email", "pii_numeric", "pii_mode", "pii_redaction_color",
                   "share_enabled", "idle_value", "idle_unit", "idle_enabled", "tab_switch_enabled")


#: Where a snapshot holds each setting.
SNAPSHOT_PATHS = {
    "blur_all_status": "blur_all.status", "blur_mode": "blur_all.settings.blur_mode",
    **{f"cat_{c}": f"blur_all.settings.blur_categories.{c}" for c in CATEGORIES},
    "pick_blur_enabled": "pick_and_blur.status", "picker_mode": "pick_and_blur.settings.picker_mode",
    "pick_blur_type": "pick_and_blur.settings.blur_type", "pick_color_hex": "pick_and_blur.settings.blur_color.hex",
    "pick_color_opacity": "pick_and_blur.settings.blur_color.opacity", "pii_email": "auto_detect_pii.settings.email",
    "pii_numeric": "auto_detect_pii.settings.numeric", "pii_mode": "auto_detect_pii.settings.pii_mode",
    "pii_redaction_color": "auto_detect_pii.settings.pii_redaction_color",
    "share_enabled": "automate.settings.screen_share.enabled", "idle_value": "automate.settings.idle.value",
    "idle_unit": "automate.settings.idle.unit", "idle_enabled": "automate.settings.idle.enabled",
    "tab_switch_enabled": "automate.settings.tab_switch.enabled",
}


def merge_snapshot(snapshot_json: Column, base: dict[str, Column]) -> Column:
    """Struct of all settings: what the snapshot itself holds laid over ``base``, the rest as it is there.

    Nothing is filled in or repaired: a rule that sets one field leaves the others to the globals.
    """
    def laid(raw: Column) -> Column:
        def held(name: str) -> Column:
            at = raw
            for part in SNAPSHOT_PATHS[name].split("."):
                at = at[part]
            return at
        return F.struct(*[(F.coalesce(held(n), base[n]) if n in SNAPSHOT_PATHS else base[n]).alias(n) for n in base])
    return let(F.from_json(snapshot_json, RAW_SNAPSHOT), laid)


def complete_snapshot(snapshot_json: Column) -> Column:
    """Null for an empty snapshot, else all settings a rule pins, filled from the defaults.

    ``blur_all_status`` alone may stay null: a rule need not decide it.
    """
    raw = F.from_json(snapshot_json, RAW_SNAPSHOT)

    def fill(s: Column) -> Column:
        blur, pick = s["blur_all"]["settings"], s["pick_and_blur"]
        pii, auto = s["auto_detect_pii"]["settings"], s["automate"]["settings"]
        unit = _enum(auto["idle"]["unit"], V.IDLE_UNITS, "idle_unit")
        value = F.when(auto["idle"]["value"].between(1, 99), auto["idle"]["value"]) \
            .otherwise(_default("idle_value"))
        fields = {
            "blur_all_status": s["blur_all"]["status"],
            "blur_mode": F.coalesce(blur["blur_mode"], _default("blur_mode")),
            **{f"cat_{c}": _flag(blur["blur_categories"][c], f"cat_{c}") for c in CATEGORIES},
            "pick_blur_enabled": _flag(pick["status"], "pick_blur_enabled"),
            "picker_mode": pick["settings"]["picker_mode"],
            "pick_blur_type": F.coalesce(pick["settings"]["blur_type"], _default("pick_blur_type")),
            "pick_color_hex": _hex(pick["settings"]["blur_color"]["hex"], "pick_color_hex"),
            "pick_color_opacity": _ranged(pick["settings"]["blur_color"]["opacity"], 0, 1,
                                          "pick_color_opacity"),
            "pii_email": _flag(pii["email"], "pii_email"),
            "pii_numeric": _flag(pii["numeric"], "pii_numeric"),
            "pii_mode": _enum(pii["pii_mode"], V.PII_MODES, "pii_mode"),
            "pii_redaction_color": _hex(pii["pii_redaction_color"], "pii_redaction_color"),
            "share_enabled": _flag(auto["screen_share"]["enabled"], "share_enabled"),
            "idle_value": _idle_value(value, unit),
            "idle_unit": unit,
            "idle_enabled": _flag(auto["idle"]["enabled"], "idle_enabled"),
            "tab_switch_enabled": _flag(auto["tab_switch"]["enabled"], "tab_switch_enabled"),
            "item_ids": F.coalesce(F.slice(pick["item_ids"], 1, V.MAX_ITEMS_PER_HOST),
                                   F.array().cast("array<string>")),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])
    empty_object = snapshot_json.isNull() | snapshot_json.rlike(r"\A\s*\{\s*\}\s*\z")
    return F.when(~empty_object, let(raw, fill))


def normalise_rules(rules: DataFrame, unknown_type: str = "wildcard", max_rules: int | None = V.MAX_RULES,
                    max_length: int = V.MAX_PATTERN_LENGTH) -> DataFrame:
    """Drop blank rules, keep the first ``max_rules`` (None: all), trim, cut and type the rest.

    The limits are the feature: a model holds at most so many rules of such a length.
    """
    kind = F.col("hostname_type")
    filled = rules.where(F.trim("hostname_value") != "")
    kept = filled if max_rules is None else filled.orderBy("rule_ord").limit(max_rules)
    return kept.select(
        "rule_ord",
        F.substring(F.trim("hostname_value"), 1, max_length).alias("hostname_value"),
        F.when(kind.isin(*V.PATTERN_TYPES), kind).otherwise(unknown_type).alias("hostname_type"),
        "snapshot")


def regex_allowed(pattern: str, spark: SparkSession | None = None, max_length: int = V.MAX_PATTERN_LENGTH) -> bool:
    """Without nested quantifiers, and a pattern both for ECMAScript and, rewritten, for the engine that runs it."""
    if not pattern or len(pattern) > max_length:
        return False
    if any(re.search(p, pattern) for p in V.NESTED_QUANTIFIER) or not ecmascript(pattern):
        return False
    jvm = (spark or SparkSession.getActiveSession())._jvm
    try:
        jvm.java.util.regex.Pattern.compile(java(pattern, True))
        return True
    except (Py4JJavaError, IllegalArgumentException):
        return False


_RULE = ("struct<rule_ord:int,hostname_value:string,hostname_type:string,"
         "scheme:string,host:string,port:string,path:string,subdomain:boolean>")


@dataclass
class RuleBook:
    """The normalised rules of one model, kept as literals inside the page expressions.

    Matching needs no join: every page row tests the rules in place, so pages
    are neither shuffled nor multiplied. ``normalise_rules`` bounds their number.
    """

    rules: list[dict]
    snapshot_type: str

    @classmethod
    def of(cls, rules: DataFrame) -> "RuleBook":
        parsed = rules.select(
            "rule_ord", "hostname_value", "hostname_type",
            U.parse_pattern(F.col("hostname_value")).alias("p"),
            complete_snapshot(F.col("snapshot")).alias("snap"), F.col("snapshot").alias("raw"))
        kept = parsed.select("rule_ord", "hostname_value", "hostname_type", "p.*", "raw",
                             F.to_json("snap", {"ignoreNullFields": "false"}).alias("snap"))
        rows = [r.asDict() for r in kept.orderBy("rule_ord").collect()]
        return cls(rows, parsed.schema["snap"].dataType.simpleString())

    def _literal(self, rows, extra=()) -> Column:
        names = [f.split(":")[0] for f in _RULE[7:-1].split(",")]
        return F.from_json(F.lit(json.dumps([{n: r[n] for n in names} for r in rows])), f"array<{_RULE}>")

    def wildcard_ord(self, parts: Column, any_type: bool = False) -> Column:
        rows = [r for r in self.rules if any_type and r["hostname_type"] != "regex"
                or r["hostname_type"] == "wildcard"]
        if not rows:
            return F.lit(None).cast("int")
        hit = F.filter(self._literal(rows), lambda r: U.wildcard_match(parts, r))
        return F.get(hit, F.lit(0))["rule_ord"]

    def regex_ord(self, url: Column) -> Column:
        chain, bare = None, F.regexp_replace(url, "#.*$", "")
        for r in self.rules:
            if r["hostname_type"] == "regex" and regex_allowed(r["hostname_value"]):
                fits = bare.rlike(java(r["hostname_value"], True))
                chain = F.when(fits, r["rule_ord"]) if chain is None else chain.when(fits, r["rule_ord"])
        return F.lit(None).cast("int") if chain is None else chain

    def first_match(self, url: Column) -> Column:
        """Lowest wildcard or regex rule that matches, null when none does."""
        return F.least(let(U.url_parts(url), lambda p: self.wildcard_ord(p)), self.regex_ord(url))

    def first_any(self, url: Column) -> Column:
        """Like :meth:`first_match`, with exact rules read as host patterns too."""
        return F.least(let(U.url_parts(url), lambda p: self.wildcard_ord(p, True)), self.regex_ord(url))

    def exact_match(self, host: Column) -> Column:
        """First exact rule for the host whose snapshot is not empty."""
        chain, seen = [], set()
        for r in self.rules:
            if r["hostname_type"] == "exact" and r["snap"] and r["hostname_value"] not in seen:
                seen.add(r["hostname_value"])
                chain += [F.lit(r["hostname_value"]), F.lit(r["rule_ord"])]
        return F.element_at(F.create_map(*chain), host) if chain else F.lit(None).cast("int")

    def snapshot(self, rule_ord: Column) -> Column:
        rows = [{"ord": r["rule_ord"], "snap": json.loads(r["snap"])} for r in self.rules if r["snap"]]
        if not rows:
            return F.lit(None).cast(self.snapshot_type)
        book = F.from_json(F.lit(json.dumps(rows)), f"array<struct<ord:int,snap:{self.snapshot_type}>>")
        return F.get(F.filter(book, lambda r: r["ord"] == rule_ord), F.lit(0))["snap"]

    def describe(self, rule_ord: Column, field: str) -> Column:
        pairs = [x for r in self.rules for x in (F.lit(r["rule_ord"]), F.lit(r[field]))]
        return F.element_at(F.create_map(*pairs), rule_ord) if pairs else F.lit(None).cast("string")


def rule_index(rules: DataFrame) -> DataFrame:
    """Normalised wildcard rules by host and path literal, the lowest of those that fit the same URLs.

    A path rule is a prefix (of no length where any path fits) or exact.
    """
    p, path = F.col("p"), F.col("p.path")
    any_path = path.isNull() | path.isin("", "/", "/*")
    parsed = with_once(rules.where("hostname_type = 'wildcard'"), p=U.parse_pattern(F.col("hostname_value")))
    return parsed.select(
        "rule_ord", p["host"].alias("rule_host"), p["subdomain"].alias("below_only"), p["scheme"].alias("rule_scheme"),
        p["port"].alias("rule_port"), (~any_path & ~path.endswith("*")).alias("exact"),
        F.when(any_path, "").when(path.endswith("*"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path).alias("literal"),
    ).groupBy("rule_host", "below_only", "rule_scheme", "rule_port", "exact", "literal").agg(F.min("rule_ord").alias("rule_ord"))


def index_match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` and ``rule_ord``, the lowest wildcard rule that fits each url; null where none does or the url is none.

    For rules without a bound: equal to ``RuleBook.wildcard_ord``, but urls and
    rules meet by equi-joins alone. A url asks for the dot suffixes of its host
    and, below one, for the prefixes of its path that are as long as some rule
    of that host, so it meets only rules that fit it up to scheme and port.
    Urls are matched once each, however many pages have them.
    """
    index = rule_index(rules)
    lengths = index.groupBy("rule_host").agg(F.collect_set(F.when(~F.col("exact"), F.length("literal"))).alias("lengths"))
    urls = pages.select("url").where("url is not null").distinct()
    parts = with_once(urls, u=U.url_parts(F.col("url"))).where("u is not null").select("url", "u.*")
    labels = F.split("host", r"\.", -1)
    above = parts.select("host").distinct().select("host", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("depth", "rule_host"))
    known = above.join(lengths, "rule_host")
    path = F.col("path")
    asked = F.array_union(
        F.transform(F.filter("lengths", lambda n: n <= F.length(path)),
                    lambda n: F.struct(F.lit(False).alias("exact"), F.substring(path, F.lit(1), n).alias("literal"))),
        F.array(F.struct(F.lit(True).alias("exact"), path.alias("literal")),
                F.struct(F.lit(True).alias("exact"), F.regexp_replace(path, r"/\z", "").alias("literal"))))
    keys = parts.join(known, "host").select("url", "scheme", "port", "depth", "rule_host", F.inline(asked))
    fits = (F.col("rule_scheme").isNull() | (F.col("rule_scheme") == F.col("scheme"))) \
        & (F.col("rule_port").isNull() | (F.col("rule_port") == F.col("port"))) & (~F.col("below_only") | (F.col("depth") > 0))
    found = keys.join(index, ["rule_host", "exact", "literal"]).where(fits).groupBy("url").agg(F.min("rule_ord").alias("rule_ord"))
    return pages.join(found, "url", "left")


def fold(pages: DataFrame, book: RuleBook, base: dict[str, Column] | None = None,
         host_items: Column | None = None) -> DataFrame:
    """Add the resolved policy of each page.

    Global settings first, then the first pattern rule, then the exact rule. A
    rule with an empty snapshot changes nothing but is still named when it is a
    pattern rule. ``base`` gives the global settings, the defaults if absent.
    """
    base = base or {n: _default(n) for n in DEFAULTS}
    items = F.array().cast("array<string>") if host_items is None else host_items
    parts = pages.withColumn("_parts", U.url_parts(F.col("url")))
    ruled = parts.withColumn("pattern_ord", book.first_match(F.col("url"))) \
        .withColumn("exact_ord", book.exact_match(F.col("_parts")["host"]))
    snaps = ruled.withColumn("_p", book.snapshot(F.col("pattern_ord"))) \
        .withColumn("_e", book.snapshot(F.col("exact_ord")))
    e, p = F.col("_e"), F.col("_p")

    def pinned(name: str) -> Column:
        if name == "blur_all_status":
            return F.coalesce(e[name], p[name], base[name])
        if name not in SNAPSHOT_FIELDS:
            return base[name]
        return F.when(e.isNotNull(), e[name]).when(p.isNotNull(), p[name]).otherwise(base[name])

    def shown(s: Column) -> Column:
        return F.when(s["pick_blur_enabled"], s["item_ids"]).otherwise(F.array().cast("array<string>"))

    any_rule = e.isNotNull() | p.isNotNull()
    touched = ("blur_mode", "blur_categories", "pick_blur_enabled", "pick_blur_type",
               "pick_blur_color", "picker_mode", "blur_items", "pii_email", "pii_numeric",
               "pii_mode", "pii_redaction_color", "automate_idle", "automate_tab_switch",
               "automate_screen_share")
    overrides = F.array_compact(F.array(
        F.when(e["blur_all_status"].isNotNull() | p["blur_all_status"].isNotNull(), "blur_all_status"),
        *[F.when(any_rule, t) for t in touched]))
    resolved = [pinned(n).alias(n) for n in DEFAULTS]
    matched = F.coalesce(F.col("exact_ord"), F.col("pattern_ord"))
    return snaps.select(
        *pages.columns, *resolved,
        F.when(e.isNotNull(), shown(e)).when(p.isNotNull(), shown(p))
        .otherwise(F.when(base["pick_blur_enabled"], items).otherwise(F.array().cast("array<string>")))
        .alias("blur_items"),
        overrides.alias("rule_overrides"), matched.alias("rule_match"),
    ).withColumn("engage", F.col("enabled") & F.col("blur_all_status"))


# ---------------------------------------------------------------- saved items


def item_id() -> Column:
    first = F.try_element_at(F.col("selectors"), F.lit(1))
    return F.when(F.col("type") == "dynamic", F.coalesce(first, F.col("selector"))).otherwise(F.col("id"))


def item_valid() -> Column:
    c = F.col
    named = c("name").isNotNull() & (F.length("name") <= V.MAX_NAME_LENGTH)
    listed = F.size("selectors").between(1, V.MAX_SELECTORS) & F.forall(
        c("selectors"), lambda s: F.length(s).between(1, V.MAX_SELECTOR_LENGTH))
    single = F.length("selector").between(1, V.MAX_SELECTOR_LENGTH)
    boxed = (F.length("id") > 0) & c("x").isNotNull() & c("y").isNotNull() \
        & c("width").isNotNull() & c("height").isNotNull()
    return F.coalesce(
        F.when(c("type") == "dynamic", named & F.when(c("selectors").isNotNull(), listed).otherwise(single))
        .when(c("type") == "sticky", named & boxed), F.lit(False)) & (F.coalesce(F.length("host"), F.lit(0)) > 0)


def admit_items(items: DataFrame) -> DataFrame:
    """Replay of saves in ``seq`` order with the reason each was refused, null when kept.

    Checked in this order: invalid item, host already full, id already there.
    Repeats never fill a host, so the first ten distinct ids per host are kept;
    later saves find the host full, earlier repeats are duplicates.
    """
    tagged = items.withColumn("item_id", item_id()).withColumn("valid", item_valid())
    # First save of each id: only these can be kept, and only ten per host are.
    firsts = tagged.where("valid").groupBy("host", "item_id").agg(F.min("seq").alias("first_seq"))
    order = Window.partitionBy("host").orderBy("first_seq")
    kept = firsts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= V.MAX_ITEMS_PER_HOST)
    full = kept.groupBy("host").agg(
        F.max(F.when(F.col("n") == V.MAX_ITEMS_PER_HOST, F.col("first_seq"))).alias("full_seq"))
    marked = tagged.join(kept.select("host", "item_id", "first_seq"), ["host", "item_id"], "left") \
        .join(full, "host", "left")
    reason = (
        F.when(~F.col("valid"), "invalid")
        .when(F.col("seq") == F.col("first_seq"), None)
        .when(F.col("seq") > F.col("full_seq"), "cap")
        .when(F.col("first_seq") < F.col("seq"), "duplicate"))
    return marked.select("seq", "host", "item_id", reason.alias("reason"))


def remove_items(items: DataFrame, removed: DataFrame) -> DataFrame:
    return items.join(removed.select("host", "item_id"), ["host", "item_id"], "left_anti")


def clear_hosts(items: DataFrame, hosts: DataFrame) -> DataFrame:
    return items.join(hosts.select("host"), "host", "left_anti")


def diff_items(desired: DataFrame, active: DataFrame) -> DataFrame:
    """Items to add, remove or keep, by host and id."""
    d = desired.select("host", "item_id").distinct().withColumn("want", F.lit(True))
    a = active.select("host", "item_id").distinct().withColumn("have", F.lit(True))
    return d.join(a, ["host", "item_id"], "full_outer").select(
        "host", "item_id",
        F.when(F.col("have").isNull(), "added").when(F.col("want").isNull(), "removed")
        .otherwise("kept").alias("change"))


def model_diff(before: DataFrame, after: DataFrame, key: str, fields) -> DataFrame:
    """Names of the settings that differ, per key present in both."""
    b, a = before.alias("b"), after.alias("a")
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), f) for f in fields]))
    return b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}")).select(
        F.col(f"b.{key}").alias(key), F.explode(changed).alias("field"))
