"""Queries over page elements: categories, cover, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values as V
from ..functions.arrays import with_once
from ..operators import elements as E
from ..operators import html, policy
from ..sources import profiles, tables
from .pages import pages, parsed
from .registry import query

c = F.col
FORMS = ("form", "table")


def _elements(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.inline("nodes")).where(c("kind").isin("open", "void", "raw"))


@query("category_dim")
def category_dim(spark, sf_dir):
    """The category lists with the number of elements behind each entry."""
    seen = _elements(spark, sf_dir).select("tag", html.attribute(c("token"), "role").alias("role"))
    counts = seen.groupBy(c("tag").alias("name")).count().withColumn("by", F.lit("tag")).unionByName(
        seen.where("role is not null").groupBy(c("role").alias("name")).count().withColumn("by", F.lit("role")))
    dim = E.category_dim(spark).withColumn("by", F.when(c("kind") == "role", "role").otherwise("tag"))
    return dim.join(counts, ["name", "by"], "left").select(
        "category", "kind", "name", "ord", F.coalesce("count", F.lit(0)).alias("elements"))


@query("category_select")
def category_select(spark, sf_dir):
    """Category key and number of active tags for every profile."""
    loaded = policy.load(profiles.profiles(spark, sf_dir))
    flags = {cat: c(f"cat_{cat}") for cat in V.CATEGORY_ORDER}

    def size(kind):
        return sum((F.when(flags[cat], len(V.CATEGORY_TAGS[cat][kind])).otherwise(0) for cat in V.CATEGORY_ORDER), F.lit(0))
    return loaded.select("profile", E.category_key(flags).alias("key"), size("always").alias("always_tags"),
                         size("check").alias("check_tags"), size("role").alias("roles"))


@query("element_category")
def element_category(spark, sf_dir):
    """Category of every element, by tag or role."""
    dim = E.category_dim(spark)
    tags = F.broadcast(dim.where("kind <> 'role'").select(c("name").alias("tag"), c("category").alias("tag_category")))
    roles = F.broadcast(dim.where("kind = 'role'").select(c("name").alias("role"), c("category").alias("role_category")))
    el = _elements(spark, sf_dir).select("page_id", "pos", "tag", html.attribute(c("token"), "role").alias("role"))
    return el.join(tags, "tag", "left").join(roles, "role", "left").where(
        "tag_category is not null or role_category is not null").select(
        "page_id", "pos", "tag", "tag_category", "role_category")


def _covered(spark, sf_dir, **kw):
    return parsed(spark, sf_dir).select("page_id", F.inline(E.covered(c("nodes"), **kw)))


@query("element_cover")
def element_cover(spark, sf_dir):
    """Covered elements under the default categories and the rule behind each."""
    return _covered(spark, sf_dir).select("page_id", "pos", "tag", "how")


@query("element_cover_thorough")
def element_cover_thorough(spark, sf_dir):
    return _covered(spark, sf_dir, categories=V.CATEGORY_ORDER, thorough=True).select("page_id", "pos", "tag", "how")


@query("cover_count")
def cover_count(spark, sf_dir):
    return _covered(spark, sf_dir).groupBy("page_id", "how").agg(F.count("*").alias("n"))


@query("visually_covered")
def visually_covered(spark, sf_dir):
    """Elements covered under the form and table categories, custom elements left alone."""
    return _covered(spark, sf_dir, categories=FORMS).groupBy("tag", "how").agg(F.count("*").alias("n"))


@query("nearest_covered_ancestor")
def nearest_covered_ancestor(spark, sf_dir):
    """Closest covered element above every text node."""
    return parsed(spark, sf_dir).select("page_id", F.inline(E.texts_under(c("nodes"), E.covered_positions(c("nodes"))))).select(
        "page_id", "pos", "under")


@query("mask_category_text")
def mask_category_text(spark, sf_dir):
    return E.mask_category_text(pages(spark, sf_dir)).select("page_id", "pos", "under", "masked")


@query("batch_top_nodes")
def batch_top_nodes(spark, sf_dir):
    """Of a batch of changed nodes, those without a changed ancestor."""
    changed = F.transform(F.filter("nodes", lambda n: n["kind"].isin("open", "text") & (n["pos"] % 7 == 3)),
                          lambda n: n["pos"])
    rows = with_once(parsed(spark, sf_dir), changed=changed)
    return rows.select("page_id", F.explode(E.top_nodes(c("nodes"), c("changed"))).alias("pos"))


def _rows(spark, sf_dir):
    return E.element_rows(pages(spark, sf_dir))


def _kept(df):
    """Parsed elements, stored once: addresses read them from several branches."""
    return tables.materialise(E.element_rows(df), "elements", "named")


@query("path_selector")
def path_selector(spark, sf_dir):
    return _rows(spark, sf_dir).select("page_id", "pos", E.path_selector().alias("selector")).where("selector is not null")


@query("anchored_selector")
def anchored_selector(spark, sf_dir):
    return E.anchored_selector(_kept(pages(spark, sf_dir))).select("page_id", "pos", c("by_anchor").alias("selector")) \
        .where("selector is not null")


@query("class_selector")
def class_selector(spark, sf_dir):
    return E.class_selector(_kept(pages(spark, sf_dir))).select("page_id", "pos", c("by_class").alias("selector")) \
        .where("selector is not null")


@query("aria_selector")
def aria_selector(spark, sf_dir):
    return E.aria_selector(_rows(spark, sf_dir)).select("page_id", "pos", c("by_aria").alias("selector")) \
        .where("selector is not null")


@query("data_selector")
def data_selector(spark, sf_dir):
    return E.data_selector(_kept(pages(spark, sf_dir))).select("page_id", "pos", c("by_data").alias("selector")) \
        .where("selector is not null")


@query("id_selector")
def id_selector(spark, sf_dir):
    return E.id_selector(_rows(spark, sf_dir)).select("page_id", "pos", c("by_id").alias("selector")) \
        .where("selector is not null")


@query("selector_list")
def selector_list(spark, sf_dir):
    return E.selector_lists(_kept(pages(spark, sf_dir))).select("page_id", "pos", F.array_join("selectors", " || ").alias("selectors"))


@query("selector_restore")
def selector_restore(spark, sf_dir):
    """Elements found again after the menu is gone and the main parts sit one level deeper."""
    lists = E.selector_lists(_kept(pages(spark, sf_dir))).select("page_id", c("pos").alias("item"), "selectors")
    stored = tables.materialise(lists, "selectors")  # paths and classes are looked up apart
    moved = F.replace(F.replace("html", F.lit("<article>"), F.lit("<main><article>")),
                      F.lit("<section id"), F.lit("<div><section id"))
    changed = pages(spark, sf_dir).withColumn("html", F.regexp_replace(moved, r"(?s)<nav\b.*?</nav>", "<p>gone</p>"))
    return E.restore(stored, _kept(changed)).groupBy("by_selector").agg(
        F.count("*").alias("items"), F.sum("found").alias("checksum"))


@query("selector_stable")
def selector_stable(spark, sf_dir):
    return E.stable(_rows(spark, sf_dir))
