"""Element categories and stable element addresses.

Cover decisions stay inside the page's row. Addresses need counts per page, so
there the elements become rows and are partitioned once, by page.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions.arrays import empty, let, marked, marks, with_once
from ..functions.rx import SPACE
from . import html, mask

NOT_BLANK = f"[^{SPACE}]"
STRUCTURAL = V.CATEGORY_TAGS["structure"]["check"]


def category_dim(spark) -> DataFrame:
    """``(category, kind, name, ord)``; kind is always, check or role."""
    rows = [(cat, kind, name, i) for cat in V.CATEGORY_ORDER for kind in ("always", "check", "role")
            for i, name in enumerate(V.CATEGORY_TAGS[cat][kind])]
    return spark.createDataFrame(rows, "category string, kind string, name string, ord int")


def names(categories: Iterable[str], kind: str) -> list[str]:
    chosen = set(categories)
    return [n for cat in V.CATEGORY_ORDER if cat in chosen for n in V.CATEGORY_TAGS[cat][kind]]


def category_key(flags: dict[str, Column]) -> Column:
    """One bit per category, in fixed order."""
    return F.concat(*[F.when(flags[cat], "1").otherwise("0") for cat in V.CATEGORY_ORDER])


def _one_of(x: Column, words) -> Column:
    return F.coalesce(x.isin(*words), F.lit(False)) if words else F.lit(False)


def covered(nodes: Column, categories: Iterable[str] = V.DEFAULT_CATEGORIES, thorough: bool = False) -> Column:
    """``array<struct<pos,tag,how>>`` of covered elements; ``how`` names the rule.

    custom: a custom element with text; always: by tag; role: by ARIA role;
    text: a tag that is covered only when it carries text of its own.
    """
    cats = set(categories)
    always, check, roles = (names(cats, k) for k in ("always", "check", "role"))
    custom_on = bool(cats & {"text", "structure"})

    def decide(n: Column, texty: Column, slotted: Column) -> Column:
        has_text = marked(texty, n["pos"])
        claimed = html.has_attribute(n["token"], mask.SPAN_ATTRIBUTE)
        by_text = F.when(_one_of(n["tag"], STRUCTURAL), has_text).otherwise(
            F.lit(thorough) | has_text | marked(slotted, n["pos"]))
        stamped = ~claimed & F.when(
            n["tag"].contains("-"), F.lit(custom_on) & (F.lit(thorough) | has_text)
        ).otherwise(_one_of(n["tag"], check) & by_text)
        how = (F.when(_one_of(n["tag"], always), "always")
               .when(stamped & n["tag"].contains("-"), "custom")
               .when(stamped, "text")
               .when(_one_of(html.attribute(n["token"], "role"), roles), "role"))
        return F.struct(n["pos"].alias("pos"), n["tag"].alias("tag"), how.alias("how"))

    def run(ns: Column) -> Column:
        slotted = marks(F.flatten(F.transform(F.filter(
            ns, lambda n: F.coalesce(n["tag"] == "slot", F.lit(False)) & (n["kind"] != "close")),
            lambda n: n["ancestors"])), F.size(ns))
        elements = F.filter(ns, lambda n: n["kind"].isin("open", "void", "raw"))
        return let(with_own_text(ns), lambda t: let(slotted, lambda s: F.filter(
            F.transform(elements, lambda n: decide(n, t, s)), lambda d: d["how"].isNotNull())))
    return let(nodes, run)


def with_own_text(nodes: Column) -> Column:
    """Marks of the elements with a text child that is not blank."""
    return marks(F.transform(F.filter(
        nodes, lambda n: (n["kind"] == "text") & (n["parent"] >= 0) & html.decode_entities(n["token"]).rlike(NOT_BLANK)),
        lambda n: n["parent"]), F.size(nodes))


def nearest(ancestors: Column, flags: Column) -> Column:
    """Innermost marked element on the way up, null when there is none."""
    return F.try_element_at(F.filter(ancestors, lambda a: marked(flags, a)), F.lit(-1))


UNDER = "struct<pos:int,under:int,token:string>"


def texts_under(nodes: Column, covered_pos: Column) -> Column:
    """``array<struct<pos,under,token>>`` of all text nodes with their closest covered element."""
    return let(nodes, lambda ns: let(marks(covered_pos, F.size(ns)), lambda flags: F.transform(
        F.filter(ns, lambda n: n["kind"] == "text"), lambda n: F.struct(
            n["pos"].alias("pos"), nearest(n["ancestors"], flags).alias("under"), n["token"].alias("token")).cast(UNDER))))


def covered_positions(nodes: Column, categories: Iterable[str] = V.DEFAULT_CATEGORIES) -> Column:
    return F.transform(covered(nodes, categories), lambda d: d["pos"])


def mask_category_text(pages: DataFrame, categories: Iterable[str] = V.DEFAULT_CATEGORIES,
                       glyph: str = mask.DISC) -> DataFrame:
    """Text nodes below covered elements, every character replaced by ``glyph``."""
    rows = with_once(pages, nodes=html.tree(F.col("html")))
    texts = rows.select("page_id", F.inline(texts_under(F.col("nodes"), covered_positions(F.col("nodes"), categories))))
    return texts.where("under is not null").select(
        "page_id", "pos", "under", F.length(html.decode_entities(F.col("token"))).alias("n_chars")) \
        .withColumn("masked", F.repeat(F.lit(glyph), F.col("n_chars")))


def top_nodes(nodes: Column, changed: Column) -> Column:
    """Changed positions that have no changed ancestor."""
    return let(nodes, lambda ns: let(marks(changed, F.size(ns)), lambda flags: F.transform(F.filter(
        ns, lambda n: marked(flags, n["pos"]) & ~html.below(n, flags)), lambda n: n["pos"])))


# ------------------------------------------------------------------ addresses


def css_escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"([^A-Za-z0-9_\-\x{80}-\x{10FFFF}])", r"\\$1"),
                            r"\A([0-9])", r"\\3$1 ")


def quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))


def _filled(x: Column) -> Column:
    return F.when(F.trim(x) != "", F.trim(x))


_STABLE = "struct<ord:int,name:string,value:string,raw:string>"


def element_rows(pages: DataFrame) -> DataFrame:
    """One row per element with its step path and its naming attributes, partitioned by page.

    Pages are dealt before they are parsed, since they are smaller than their
    elements and cost far more to parse than to read. ``named`` elements carry
    an attribute that selectors look at, ``above`` are the ancestors that may
    carry one, as ``(depth, anc)``. Where a ``page_id`` comes more than once a
    name may stand in another copy, so there every element and ancestor counts.
    """
    # rows without a page meet no others, so they need not come together
    key = ["page_id", F.when(F.col("page_id").isNull(), F.xxhash64("html"))]
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = pages.select("page_id", "html").repartition(parts, *key).withColumn(
        "alone", F.col("page_id").isNull() | (F.count("*").over(Window.partitionBy(*key)) == 1))
    tree = html.element_tree(F.col("html"), ("id", *V.STABLE_ATTRIBUTES), ~F.col("alone"))
    el = with_once(counted, nodes=tree).select("page_id", "alone", F.inline("nodes"))
    at = lambda name: html.attribute(F.col("head"), name)
    classes = F.filter(F.split(at("class"), r"\s+"), lambda x: x != "")
    stable = F.array_compact(F.array(*[F.when(_filled(at(a)).isNotNull(), F.struct(
        F.lit(i).alias("ord"), F.lit(a).alias("name"), F.trim(at(a)).alias("value"), at(a).alias("raw")).cast(_STABLE))
        for i, a in enumerate(V.STABLE_ATTRIBUTES)]))
    rows = el.select(
        "page_id", "pos", "tag", "parent", "ancestors", "steps", at("id").alias("id"),
        at("aria-label").alias("aria"), F.coalesce(classes, empty("string")).alias("classes"),
        F.when(F.col("head").rlike(rf"(?is)\s(?:{'|'.join(V.STABLE_ATTRIBUTES)})\s*="), stable).otherwise(empty(_STABLE)).alias("stable"),
        "above", "alone")
    named = ~F.col("alone") | F.col("id").isNotNull() | F.col("aria").isNotNull() | (F.size("classes") > 0) | (F.size("stable") > 0)
    return rows.withColumn("named", named).drop("alone")


def path_selector() -> Column:
    """Steps below the body; null for the body and the root themselves."""
    steps = F.col("steps")

    def first(tag: str) -> Column:
        """Place of the first step of that tag, mostly the first or second; 0 for none."""
        at = lambda i: F.coalesce(F.get(steps, F.lit(i)).startswith(f"{tag}:"), F.lit(False))
        return F.when(at(0), 1).when(at(1), 2).otherwise(
            F.array_position(F.transform(steps, lambda s: s.startswith(f"{tag}:")), True))
    body, root = first("body"), first("html")
    top = F.when(body > 0, body).otherwise(F.greatest(root, F.lit(1))).cast("int")
    below = F.slice(steps, top + 1, F.size(steps))
    return F.when(~F.col("tag").isin("body", "html") & (F.size(below) > 0),
                  F.concat(F.lit("body > "), F.array_join(below, " > ")))


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of elements that sends no side whole: stored elements are hundreds of times larger than their files."""
    return left.join(right.hint("merge"), on, how)


def _counted(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with how many share each value of ``by``; rows without one are counted with none."""
    n = rows.where(F.col(by[-1]).isNotNull()).groupBy("page_id", *by).agg(F.count("*").alias(name))
    return _met(rows, n, ["page_id", *by], "left")


def id_selector(rows: DataFrame) -> DataFrame:
    unique = (F.col("_n") == 1) & (F.trim("id") == F.col("id")) & (F.col("id") != "")
    return _counted(rows, ["id"], "_n").withColumn("by_id", F.when(
        unique, F.concat(F.lit("#"), css_escape(F.col("id"))))).drop("_n")


def aria_selector(rows: DataFrame) -> DataFrame:
    unique = (F.col("_n") == 1) & (F.trim("aria") == F.col("aria")) & (F.col("aria") != "") \
        & (F.length("aria") <= V.ARIA_LABEL_LIMIT)
    return _counted(rows, ["tag", "aria"], "_n").withColumn("by_aria", F.when(
        unique, F.concat(F.col("tag"), F.lit("[aria-label="), quoted(F.col("aria")), F.lit("]")))).drop("_n")


def attribute_selector(name: Column, value: Column) -> Column:
    return F.concat(F.lit("["), name, F.lit("="), quoted(value), F.lit("]"))


def data_selector(rows: DataFrame) -> DataFrame:
    """First stable attribute that is unique in the page, alone or with the tag.

    A selector names the trimmed value, so an attribute with outer spaces, which it would not match, gives none.
    """
    flat = rows.select("page_id", "pos", "tag", F.inline("stable"))
    exact = _counted(_counted(flat, ["name", "raw"], "_a"), ["tag", "name", "raw"], "_t")
    sel = attribute_selector(F.col("name"), F.col("value"))
    best = exact.where("raw = value").withColumn(
        "sel", F.when(F.col("_a") == 1, sel).when(F.col("_t") == 1, F.concat(F.col("tag"), sel))) \
        .where("sel is not null").groupBy("page_id", "pos").agg(F.min_by("sel", "ord").alias("by_data"))
    return _met(rows, best, ["page_id", "pos"], "left")


def matching_classes(wanted: DataFrame, held: DataFrame, scope: list[str]) -> DataFrame:
    """``wanted(*scope, set)`` with ``n``: in how many rows of ``held(*scope, set, n, ..)`` all its classes stand.

    The sets meet on one class, so no list of sets is carried along.
    """
    one = wanted.withColumn("_key", F.array_min("set"))
    more = held.select(*scope, F.col("set").alias("_held"), "n", F.explode("set").alias("_key"))
    met = _met(one, more, [*scope, "_key"]).where(F.size(F.array_except("set", "_held")) == 0)
    return met.groupBy(*scope, "set").agg(F.sum("n").alias("n"))


def class_selector(rows: DataFrame) -> DataFrame:
    """Tag and classes, below the parent's id when that is unique; kept even when not unique."""
    named = rows.where("id is not null and id <> ''").select(
        "page_id", F.col("pos").alias("parent"), F.col("id").alias("parent_id"))
    own = F.concat(F.col("tag"), F.lit("."), F.array_join(F.transform("classes", css_escape), "."))
    classed = _met(rows.where(F.size("classes") > 0).select(
        "page_id", "pos", "tag", "parent", F.array_sort(F.array_distinct("classes")).alias("set"), own.alias("own")),
        named, ["page_id", "parent"], "left")
    # Elements that would match too: same tag under that id with at least these classes.
    scope = ["page_id", "parent_id", "tag"]
    sets = classed.where("parent_id is not null").groupBy(*scope, "set").agg(F.count("*").alias("n"))
    scoped = _met(classed, matching_classes(sets.drop("n"), sets, scope), [*scope, "set"], "left")
    by_class = F.when(F.col("n") == 1, F.concat(
        F.lit("#"), css_escape(F.col("parent_id")), F.lit(" > "), F.col("own"))).otherwise(F.col("own"))
    return _met(rows, scoped.select("page_id", "pos", by_class.alias("by_class")), ["page_id", "pos"], "left")


def anchor_paths(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """``anchors(page_id, pos, ..)`` met by every element below them: (page_id, pos, anc, path, ..)."""
    below = rows.where(~F.col("tag").isin("body", "html")).select("page_id", "pos", "steps", F.inline("above"))
    path = F.array_join(F.slice("steps", F.col("depth") + 2, F.size("steps")), " > ")
    return _met(below.select("page_id", "pos", "anc", path.alias("path")),
                anchors.withColumnRenamed("pos", "anc"), ["page_id", "anc"])


def anchored(rows: DataFrame) -> DataFrame:
    """``(page_id, pos, by_anchor)`` of the elements below an anchor, see :func:`anchored_selector`."""
    first = F.get(F.col("stable"), F.lit(0))
    anchor_id = F.when(F.col("tag") != "body", _filled(F.col("id")))
    named = rows.where("named")
    anchors = named.select(
        "page_id", "pos", anchor_id.alias("aid"),
        F.when(anchor_id.isNull(), first["name"]).alias("aname"),
        F.when(anchor_id.isNull(), first["value"]).alias("avalue")).where("aid is not null or aname is not null")
    id_counts = named.where("id is not null").groupBy("page_id", F.col("id").alias("aid")).agg(F.count("*").alias("id_n"))
    attr_counts = named.select("page_id", F.inline("stable")).groupBy(
        "page_id", F.col("name").alias("aname"), F.col("raw").alias("avalue")).agg(F.count("*").alias("attr_n"))
    rated = _met(_met(anchors, id_counts, ["page_id", "aid"], "left"), attr_counts, ["page_id", "aname", "avalue"], "left")
    text = F.when(F.col("aid").isNotNull(), F.concat(F.lit("#"), css_escape(F.col("aid")))).otherwise(
        attribute_selector(F.col("aname"), F.col("avalue")))
    unique = F.when(F.col("aid").isNotNull(), F.col("id_n") == 1).otherwise(F.col("attr_n") == 1)
    rated = rated.select("page_id", "pos", F.when(unique, text).alias("anchor"))
    near = anchor_paths(rows, rated).groupBy("page_id", "pos").agg(
        F.max(F.struct("anc", "anchor", "path")).alias("near"))
    return near.select("page_id", "pos", F.concat("near.anchor", F.lit(" > "), F.col("near.path")).alias("by_anchor"))


def anchored_selector(rows: DataFrame) -> DataFrame:
    """Path from the nearest ancestor with an id or stable attribute, if that anchor is unique."""
    return _met(rows, anchored(rows), ["page_id", "pos"], "left")


def selector_lists(rows: DataFrame) -> DataFrame:
    """Ordered selectors of every element, most structural first.

    Only named elements go through the joins that look for a name of their own.
    """
    brief = rows.select("page_id", "pos", "tag", path_selector().alias("by_path"), "parent", "id", "aria", "classes", "stable", "named")
    own = ("by_class", "by_aria", "by_data", "by_id")
    kept = ("page_id", "pos", "tag", "by_path", *own)
    named = id_selector(aria_selector(data_selector(class_selector(brief.where("named"))))).select(*kept)
    bare = brief.where("not named").withColumns({name: F.lit(None).cast("string") for name in own}).select(*kept)
    full = _met(named.unionByName(bare), anchored(rows), ["page_id", "pos"], "left")
    picked = F.array_distinct(F.array_compact(F.array("by_path", "by_anchor", *own)))
    return full.select("page_id", "pos", "tag", F.when(F.col("tag").isin("body", "html"), empty("string"))
                       .otherwise(picked).alias("selectors"))


_NAME = r"(?:\\3[0-9] |\\.|[^\s.#>\[\\])+"
CLASSED = rf"\A(?:#({_NAME}) > )?([a-z][a-z0-9-]*)((?:\.{_NAME})+)\z"


def css_plain(x: Column) -> Column:
    """The name that :func:`css_escape` wrote."""
    return F.regexp_replace(F.regexp_replace(x, r"\\3([0-9]) ", "$1"), r"\\([^0-9])", "$1")


def restore(stored: DataFrame, target: DataFrame) -> DataFrame:
    """First stored selector that matches exactly one element of the target page, read as CSS does.

    ``stored(page_id, item, selectors)``, ``target`` as given by
    :func:`element_rows`. Paths and attributes meet by the exact text an element
    answers to, whether or not it is unique there; classes by their set, so an
    element with more classes matches too.
    """
    wanted = stored.select("page_id", "item", F.posexplode("selectors").alias("ord", "sel")).where("sel is not null")
    held = target.where("named")
    inner = held.select("page_id", "pos", "tag", F.inline("stable"))
    by_attribute = attribute_selector(F.col("name"), F.col("raw"))
    by_id = F.concat(F.lit("#"), css_escape(F.col("id")))
    named = held.where("id <> ''").select("page_id", "pos", by_id.alias("anchor")).unionByName(
        inner.select("page_id", "pos", by_attribute.alias("anchor")))
    answers = [
        target.where(~F.col("tag").isin("body", "html")).select("page_id", "pos", path_selector().alias("sel")),
        anchor_paths(target, named).select("page_id", "pos", F.concat("anchor", F.lit(" > "), F.col("path")).alias("sel")),
        held.where("aria is not null").select(
            "page_id", "pos", F.concat(F.col("tag"), F.lit("[aria-label="), quoted(F.col("aria")), F.lit("]")).alias("sel")),
        named.select("page_id", "pos", F.col("anchor").alias("sel")),
        inner.select("page_id", "pos", F.concat(F.col("tag"), by_attribute).alias("sel")),
    ]
    # A selector and what answers to it lie in one window; they begin alike, so a hash of theirs puts them in order first.
    plain = wanted
    for more in answers:
        plain = plain.unionByName(more, allowMissingColumns=True)
    same = Window.partitionBy("page_id", "_hash", "sel")
    exact = plain.where("page_id is not null").withColumn("_hash", F.xxhash64("sel")).select(
        "page_id", "item", "ord", F.count("pos").over(same).alias("n"), F.min("pos").over(same).alias("found")).where("ord is not null")

    parts = wanted.where(F.col("sel").contains(".") & F.col("sel").rlike(CLASSED)).select(
        "page_id", "item", "ord", css_plain(F.regexp_extract("sel", CLASSED, 1)).alias("under"),
        F.regexp_extract("sel", CLASSED, 2).alias("tag"),
        F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(
            F.regexp_extract("sel", CLASSED, 3), F.lit(rf"\.({_NAME})"), F.lit(1)), css_plain))).alias("set"))
    parents = held.select("page_id", F.col("pos").alias("parent"), F.col("id").alias("parent_id"))
    classed = _met(held.where(F.size("classes") > 0), parents, ["page_id", "parent"], "left").select(
        "page_id", "pos", "tag", "parent_id", F.col("classes").alias("held"), F.explode(F.array_distinct("classes")).alias("_key"))
    met = _met(parts.withColumn("_key", F.array_min("set")), classed, ["page_id", "tag", "_key"]).where(
        (F.size(F.array_except("set", "held")) == 0) & ((F.col("under") == "") | (F.col("under") == F.col("parent_id"))))
    by_class = met.groupBy("page_id", "item", "ord").agg(F.count("*").alias("n"), F.min("pos").alias("found"))
    return exact.unionByName(by_class).where("n = 1").groupBy("page_id", "item").agg(
        F.min_by("found", "ord").alias("found"), F.min("ord").alias("by_selector"))


def stable(rows: DataFrame) -> DataFrame:
    """Does the element carry a name that outlives a redesign of the page?"""
    named = (F.coalesce(F.col("id"), F.lit("")) != "") | (F.coalesce(F.col("aria"), F.lit("")) != "") \
        | (F.size("classes") > 0) | (F.size("stable") > 0)
    return rows.select("page_id", "pos", "tag", named.alias("stable"))
