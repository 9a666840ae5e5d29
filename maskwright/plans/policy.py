"""Queries over settings, rules and saved items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.arrays import with_once
from ..operators import policy
from ..sources import profiles, tables
from .pages import pages, scan_pages
from .registry import query

c = F.col


def _rules(spark, sf_dir):
    return policy.normalise_rules(profiles.site_rules(spark, sf_dir))


def _book(spark, sf_dir):
    return policy.RuleBook.of(_rules(spark, sf_dir))


@query("policy_load")
def policy_load(spark, sf_dir):
    """Settings JSON of every profile, repaired and migrated."""
    return policy.load(profiles.profiles(spark, sf_dir))


@query("model_validate")
def model_validate(spark, sf_dir):
    """How often each setting kept a value other than its default."""
    loaded = policy_load(spark, sf_dir)
    fields = list(policy.DEFAULTS)
    counted = loaded.agg(*[F.count_if(~c(f).eqNullSafe(policy._default(f))).alias(f) for f in fields])
    return counted.unpivot([], fields, "field", "changed")


@query("policy_export")
def policy_export(spark, sf_dir):
    """Repaired models as JSON, read back: nothing is lost."""
    loaded = policy_load(spark, sf_dir)
    out = loaded.select("profile", policy.export(loaded).alias("settings"))
    return policy.load(out)


@query("parse_pattern")
def parse_pattern(spark, sf_dir):
    rules = profiles.site_rules(spark, sf_dir)
    return rules.select("rule_ord", U.parse_pattern(c("hostname_value")).alias("p")).select("rule_ord", "p.*")


@query("rules_normalise")
def rules_normalise(spark, sf_dir):
    return _rules(spark, sf_dir).select("rule_ord", "hostname_value", "hostname_type")


@query("host_match")
def host_match(spark, sf_dir):
    """Page hosts under the parent host of another page, equal or below.

    Hosts meet on an equi-join of their dot suffixes, not on a pairwise test.
    """
    hosts = pages(spark, sf_dir).select(U.url_parts(c("url"))["host"].alias("host")).where("host is not null")
    seen = hosts.groupBy("host").agg(F.count("*").alias("pages"))
    labels = F.split("host", r"\.")
    suffixes = seen.select("host", "pages", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    patterns = seen.select(F.regexp_replace("host", r"\A[^.]*\.", "").alias("pattern")).distinct()
    return suffixes.join(patterns, suffixes["suffix"] == patterns["pattern"]).groupBy("pattern").agg(
        F.sum("pages").alias("matched"),
        F.sum(F.when(c("host") != c("pattern"), c("pages")).otherwise(0)).alias("below"))


@query("path_match")
def path_match(spark, sf_dir):
    """Page paths against path rules built from the page key."""
    pattern = F.expr("CASE page_id % 6 WHEN 0 THEN '/en*' WHEN 1 THEN '/*' WHEN 2 THEN '/fr/825' "
                     "WHEN 3 THEN '/' WHEN 4 THEN CAST(NULL AS STRING) ELSE concat('/en/', page_id) END")
    return pages(spark, sf_dir).select("page_id", U.url_parts(c("url"))["path"].alias("path")) \
        .where("path is not null").select("page_id", U.path_match(c("path"), pattern).alias("matched"))


@query("rule_match_wildcard")
def rule_match_wildcard(spark, sf_dir):
    """First pattern rule of each page, by URL parts."""
    book = _book(spark, sf_dir)
    parts = with_once(pages(spark, sf_dir).select("page_id", "url"), u=U.url_parts(c("url")))
    return parts.select("page_id", book.wildcard_ord(c("u")).alias("rule_ord"))


@query("rule_index_match")
def rule_index_match(spark, sf_dir):
    """First pattern rule of each page where every page host has a rule of its own, by equi-joins."""
    rules = policy.normalise_rules(profiles.host_rules(spark, sf_dir), max_rules=None)
    return policy.index_match(pages(spark, sf_dir).select("page_id", "url"), rules).select("page_id", "rule_ord")


@query("rule_match_regex")
def rule_match_regex(spark, sf_dir):
    """First regex rule of each page; unsafe and broken patterns never match."""
    return pages(spark, sf_dir).select("page_id", _book(spark, sf_dir).regex_ord(c("url")).alias("rule_ord"))


@query("rule_match_exact")
def rule_match_exact(spark, sf_dir):
    book = _book(spark, sf_dir)
    return pages(spark, sf_dir).select(
        "page_id", book.exact_match(U.url_parts(c("url"))["host"]).alias("rule_ord"))


@query("first_match")
def first_match(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", _book(spark, sf_dir).first_match(c("url")).alias("rule_ord"))


def _folded(spark, sf_dir):
    base = {n: policy._default(n) for n in policy.DEFAULTS}
    base["pick_blur_enabled"] = c("page_id") % 2 == 0
    items = F.array(F.concat(F.lit("h"), c("page_id").cast("string")))
    return policy.fold(pages(spark, sf_dir).select("page_id", "url"), _book(spark, sf_dir), base, items)


@query("policy_fold")
def policy_fold(spark, sf_dir):
    """Resolved settings of every page."""
    return _folded(spark, sf_dir).select("page_id", *policy.DEFAULTS)


@query("override_provenance")
def override_provenance(spark, sf_dir):
    """Which settings a rule decided, and which rule."""
    return _folded(spark, sf_dir).select(
        "page_id", "rule_match", F.array_join(F.array_sort("rule_overrides"), ",").alias("overrides"))


@query("items_replace")
def items_replace(spark, sf_dir):
    """Items of a rule replace the host's items, even when the rule has none."""
    return _folded(spark, sf_dir).select("page_id", F.array_join("blur_items", ",").alias("items"))


@query("engage_flag")
def engage_flag(spark, sf_dir):
    return _folded(spark, sf_dir).groupBy("enabled", "blur_all_status", "engage").agg(F.count("*").alias("n"))


@query("resolve_merge")
def resolve_merge(spark, sf_dir):
    """The older resolver: what the first rule of any kind holds, laid over each page's globals."""
    book = _book(spark, sf_dir)
    odd = c("page_id") % 2 == 1
    base = {n: policy._default(n) for n in policy.DEFAULTS} | {
        "blur_radius": (c("page_id") % 25).cast("double"), "pii_mode": F.when(odd, "starred").otherwise("blur"), "cat_form": odd,
        "pii_email": ~odd, "idle_unit": F.when(odd, "sec").otherwise("min"), "blur_mode": F.when(odd, "masked").otherwise("blur")}
    found = with_once(pages(spark, sf_dir).select("page_id", "url"), rule_ord=book.first_any(c("url")))
    merged = policy.merge_snapshot(book.describe(c("rule_ord"), "raw"), base)
    return with_once(found, s=merged).select("page_id", "rule_ord", "s.*")


@query("snapshot_complete")
def snapshot_complete(spark, sf_dir):
    """Rule snapshots filled to their full shape; an empty one stays empty."""
    rules = profiles.site_rules(spark, sf_dir)
    done = with_once(rules, s=policy.complete_snapshot(c("snapshot")))
    return done.select("rule_ord", c("s").isNull().alias("is_empty"), "s.blur_all_status", "s.blur_mode",
                       "s.cat_text", "s.cat_form", "s.cat_media", "s.pick_blur_enabled", "s.picker_mode",
                       "s.pii_email", "s.pii_numeric", "s.pii_mode", "s.pii_redaction_color",
                       "s.idle_value", "s.idle_unit", F.array_join("s.item_ids", ",").alias("items"))


@query("policy_page_scan")
def policy_page_scan(spark, sf_dir):
    """Pages scanned for the families their policy turns on."""
    book = _book(spark, sf_dir)
    base = {n: policy._default(n) for n in policy.DEFAULTS}
    base["pii_email"] = c("page_id") % 3 == 0
    ruled = policy.fold(pages(spark, sf_dir), book, base)
    return scan_pages(ruled, email=c("pii_email"), numeric=c("pii_numeric")).groupBy("type", "detector").agg(
        F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("items_admit")
def items_admit(spark, sf_dir):
    """Every save with the reason it was refused."""
    return policy.admit_items(profiles.saved_items(spark, sf_dir)).select("seq", "host", "item_id", "reason")


def _kept(spark, sf_dir):
    return items_admit(spark, sf_dir).where("reason is null")


@query("items_remove")
def items_remove(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    gone = profiles.saved_items(spark, sf_dir).where("seq % 5 = 0").withColumn("item_id", policy.item_id())
    return policy.remove_items(kept, gone).select("host", "item_id")


@query("host_clear")
def host_clear(spark, sf_dir):
    nations = tables.read(spark, sf_dir, "nation").where("n_regionkey = 1").select(
        F.concat(c("n_nationkey").cast("string"), F.lit(".example.com")).alias("host"))
    return policy.clear_hosts(_kept(spark, sf_dir), nations).select("host", "item_id")


@query("items_diff")
def items_diff(spark, sf_dir):
    items = profiles.saved_items(spark, sf_dir).withColumn("item_id", policy.item_id()).where("item_id is not null")
    return policy.diff_items(items.where("seq % 3 <> 1"), items.where("seq % 4 <> 2"))


@query("model_diff")
def model_diff(spark, sf_dir):
    """Settings that differ between a profile and the one before it."""
    loaded = policy_load(spark, sf_dir)
    shifted = loaded.withColumn("profile", c("profile") + 1)
    return policy.model_diff(shifted, loaded, "profile", list(policy.DEFAULTS))
