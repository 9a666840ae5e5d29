"""Pages as node arrays.

A page is cut into tokens by one regex and the open elements are tracked by a
fold over the token array, all inside the page's row: no shuffle, no driver,
no parser outside Spark. Unclosed paragraphs and list items are closed the way
browsers close them; elements without end tag never nest.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from ..functions.arrays import empty, laid_out, let, marked, marks, scan_fold
from ..functions.matching import find_all
from ..functions.rx import java

TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|<noscript\b[^>]*>.*?(?:</noscript\s*>|\z)"
    r"|<textarea\b[^>]*>.*?(?:</textarea\s*>|\z)"
    r"|<title\b[^>]*>.*?(?:</title\s*>|\z)"
    r"|<![^>]*>"
    r"|</?[a-z](?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+>"
    r"|[^<]++|<"
)
TAG_NAME = r"(?i)\A</?([a-z][^\s/>]*)"
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
NODE = ("struct<pos:int,kind:string,tag:string,token:string,parent:int,"
        "ancestors:array<int>,seg:int>")
_FRAME = "struct<tag:string,pos:int>"
_PLACE = "struct<parent:int,ancestors:array<int>,seg:int>"

# Which open elements a start tag closes, and what shields them.
IMPLIED_END = (
    (("li",), ("li",), ("ul", "ol")),
    (("dd", "dt"), ("dd", "dt"), ("dl",)),
    (("td", "th"), ("td", "th"), ("tr", "table")),
    (("tr",), ("tr",), ("table",)),
    (V.BLOCK_TAGS, ("p",), ("button", "table", "td", "th", "caption")),
)


def tokens(html: Column) -> Column:
    return find_all(html, TOKEN)


def kind(token: Column, tag: Column) -> Column:
    """text, comment, doctype, raw, close, void or open; ``tag`` is the name of the token's tag, empty for none."""
    return (
        F.when(token.startswith("<!--"), "comment")
        .when(token.startswith("<!"), "doctype")
        .when(tag == "", "text")
        .when(token.startswith("</"), "close")
        .when(tag.isin(*V.RAW_TEXT_TAGS), "raw")
        .when(tag.isin(*V.VOID_TAGS) | token.endswith("/>"), "void")
        .otherwise("open")
    )


def tag_name(token: Column) -> Column:
    """Name of the token's tag, empty for comments, doctypes and text; evaluate it once."""
    return F.when(token.startswith("<"), F.lower(F.regexp_extract(token, TAG_NAME, 1))).otherwise("")


def token_struct(token: Column, pos: Column) -> Column:
    return let(tag_name(token), lambda tag: F.struct(
        pos.alias("pos"), kind(token, tag).alias("kind"),
        F.when(tag != "", tag).alias("tag"),
        token.alias("token")))


def page_nodes(html: Column, found: Column | None = None) -> Column:
    """Ordered tokens ``array<struct<pos,kind,tag,token>>``, from ``found`` where the page is cut already."""
    return F.transform(tokens(html) if found is None else found, token_struct)


# A leaf is open and ended by the next tag, so nothing is ever below it.
STARTS = ("open", "leaf", "void", "raw")


def _last(stack: Column, wanted) -> Column:
    """Index of the innermost open element that satisfies ``wanted``, or -1."""
    return F.coalesce(F.array_max(F.transform(
        stack, lambda s, i: F.when(wanted(s["tag"]), i))), F.lit(-1))


def _pop(stack: Column, tag: Column) -> Column:
    """Open elements after the end tag ``tag``, which mostly ends the innermost."""
    index = _last(stack, lambda s: s == tag)
    return F.when(F.get(stack, F.size(stack) - 1)["tag"] == tag, F.slice(stack, F.lit(1), F.size(stack) - 1)) \
        .when(F.exists(stack, lambda s: s["tag"] == tag), F.slice(stack, F.lit(1), index)).otherwise(stack)


def _open_before(stack: Column, t: Column) -> Column:
    """Open elements once the end tags implied by ``t`` are accounted for."""
    tag = t["tag"]
    result = F.when(~tag.isin(*sorted({x for tags, _, _ in IMPLIED_END for x in tags})), stack)
    for tags, closed, shields in IMPLIED_END:
        target = _last(stack, lambda s: s.isin(*closed))
        shield = _last(stack, lambda s: s.isin(*shields))
        closes = F.exists(stack, lambda s: s["tag"].isin(*closed)) & (target > shield)
        result = result.when(tag.isin(*tags), F.when(closes, F.slice(stack, F.lit(1), target)).otherwise(stack))
    return F.when(t["kind"] == "close", _pop(stack, tag)) \
        .when(t["kind"].isin(*STARTS), result.otherwise(stack)) \
        .otherwise(stack)


def _open_after(stack: Column, t: Column) -> Column:
    """Open elements behind the token ``t``, itself included where it opens one."""
    before = _open_before(stack, t)
    return F.when(t["kind"] == "open", F.concat(before, F.array(
        F.struct(t["tag"].alias("tag"), t["pos"].alias("pos")).cast(_FRAME)))).otherwise(before)


def tree(html: Column, found: Column | None = None) -> Column:
    """Nodes with parent, ancestors (outermost first) and block segment."""
    def step(state: Column, t: Column) -> Column:
        return F.struct(
            _open_after(state["stack"], t).alias("stack"), state["next"].alias("seg"),
            (state["next"] + F.when(F.coalesce(t["tag"].isin(*V.BLOCK_TAGS), F.lit(False)), 1)
             .otherwise(0)).alias("next"))

    def emit(state: Column, t: Column) -> Column:
        above = F.transform(state["stack"], lambda s: s["pos"])
        above = F.when(t["kind"] == "open", F.slice(above, F.lit(1), F.size(above) - 1)).otherwise(above)
        return let(above, lambda up: F.struct(
            F.coalesce(F.try_element_at(up, F.lit(-1)), F.lit(-1)).alias("parent"),
            up.alias("ancestors"), state["seg"].alias("seg")).cast(_PLACE))

    def run(ns: Column) -> Column:
        # the text of the tokens stays out of the fold
        slim = F.transform(ns, lambda n: F.struct(n["pos"].alias("pos"), n["kind"].alias("kind"), n["tag"].alias("tag")))
        start = F.struct(empty(_FRAME).alias("stack"), F.lit(0).alias("seg"), F.lit(0).alias("next"))
        places = scan_fold(slim, start, step, emit, _PLACE, emit_after=True)
        return let(places, lambda ps: F.transform(ns, lambda n, i: F.struct(
            n["pos"].alias("pos"), n["kind"].alias("kind"), n["tag"].alias("tag"), n["token"].alias("token"),
            F.get(ps, i)["parent"].alias("parent"), F.get(ps, i)["ancestors"].alias("ancestors"),
            F.get(ps, i)["seg"].alias("seg")).cast(NODE)))
    return let(page_nodes(html, found), run)


def attribute(token: Column, name: str) -> Column:
    """Value of one attribute of a tag token, null when absent."""
    pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+)"""
    found = F.regexp_extract(token, pattern, 1)
    return F.when(token.rlike(pattern), F.regexp_replace(found, r"""\A["']|["']\z""", ""))


def has_attribute(token: Column, name: str) -> Column:
    return token.rlike(rf"(?is)\s{name}(?=[\s=/>])")


def below(node: Column, flags: Column) -> Column:
    """Is the node below one of the elements that :func:`marks` has marked?"""
    return F.exists(node["ancestors"], lambda a: marked(flags, a))


def skip_roots(nodes: Column) -> Column:
    """Positions of elements whose text is never scanned."""
    is_element = lambda n: n["kind"].isin("open", "raw", "void")

    def is_root(n: Column, coded: Column, framed: Column) -> Column:
        classes = F.coalesce(attribute(n["token"], "class"), F.lit(""))
        code_pre = (n["tag"] == "pre") & (
            marked(coded, n["pos"]) | classes.contains("highlight")
            | classes.contains("lang") | has_attribute(n["token"], "data-code")
            | marked(framed, n["parent"]))
        editor = has_attribute(n["token"], "data-code") | F.arrays_overlap(
            F.split(classes, r"\s+"), F.array(*[F.lit(c) for c in V.EDITOR_CLASSES]))
        return is_element(n) & (n["tag"].isin(*V.SKIP_TAGS) | code_pre | editor)

    def run(ns: Column) -> Column:
        coded = marks(F.flatten(F.transform(
            F.filter(ns, lambda n: is_element(n) & (n["tag"] == "code")), lambda n: n["ancestors"])), F.size(ns))
        framed = marks(F.transform(
            F.filter(ns, lambda n: is_element(n) & (n["tag"] == "div")
                     & F.coalesce(attribute(n["token"], "class").contains("highlight"), F.lit(False))),
            lambda n: n["pos"]), F.size(ns))
        return let(coded, lambda c: let(framed, lambda f: F.transform(
            F.filter(ns, lambda n: is_root(n, c, f)), lambda n: n["pos"])))
    return let(nodes, run)


# Named references as the standard library lists them; some stand without a semicolon too.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
REFERENCE = rf"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{_BARE}))"
_REPLACED = {c: bytes([c]).decode("cp1252", "replace") for c in range(128, 160)}


def _numbered(ref: Column) -> Column:
    """The character of a numeric reference; numbers that are none give the replacement sign."""
    hexed = F.regexp_extract(ref, r"\A&#[xX]0*([0-9A-Fa-f]*)", 1)
    plain = F.regexp_extract(ref, r"\A&#0*([0-9]*)", 1)
    # Eight digits without leading zeros are beyond the last character in either base.
    first = lambda x: F.when(x == "", "0").otherwise(F.left(x, F.lit(8)))
    number = F.when(ref.rlike(r"\A&#[xX]"), F.conv(first(hexed), 16, 10)).otherwise(first(plain)).cast("long")
    number = F.when(F.greatest(F.length(hexed), F.length(plain)) > 8, -1).otherwise(number)
    old = F.create_map(*[F.lit(x) for c, v in _REPLACED.items() if v != "\ufffd" for x in (c, v)])

    def char(n: Column) -> Column:
        known = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        code = F.when(known, n).otherwise(0xFFFD)
        return F.coalesce(F.try_element_at(old, n.cast("int")),
                          F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return let(number, char)


def decode_entities(text: Column) -> Column:
    """Character references as a browser reads them in text: named, decimal, hexadecimal."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def one(ref: Column) -> Column:
        name = F.substring(ref, F.lit(2), F.length(ref))
        start = F.regexp_extract(ref, rf"\A&({_BARE})", 1)  # an unknown name may begin with a known one
        cut = F.when(start == "", ref).otherwise(F.concat(
            F.try_element_at(names, start), F.substring(ref, F.length(start) + 2, F.length(ref))))
        return F.when(ref.startswith("&#"), _numbered(ref)).otherwise(F.coalesce(F.try_element_at(names, name), cut))

    def decode(t: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), one)
        return F.when(t.contains("&"), let(refs, lambda cs: F.array_join(F.transform(
            F.split(t, REFERENCE, -1), lambda p, i: F.concat(p, F.coalesce(F.get(cs, i), F.lit("")))), ""))).otherwise(t)
    return let(text, decode)


TEXT_NODE = "struct<pos:int,parent:int,text:string,preceding:string>"


def text_nodes(nodes: Column) -> Column:
    """Text below the body that a scan may look at, with the text just before it.

    ``preceding`` is filled only for nodes that hold nothing but a short number;
    it is the text since the last block boundary, at most 120 characters.
    """
    def pick(ns: Column) -> Column:
        body = F.transform(F.filter(ns, lambda n: (n["kind"] == "open") & (n["tag"] == "body")),
                           lambda n: n["pos"])

        def with_roots(roots: Column, body: Column, no_body: Column) -> Column:
            visible = F.filter(ns, lambda n: (n["kind"] == "text") & ~below(n, roots) & (no_body | below(n, body)))

            read = F.transform(visible, lambda n: F.struct(
                n["pos"].alias("pos"), n["parent"].alias("parent"), n["seg"].alias("seg"),
                decode_entities(n["token"]).alias("text")))

            def tail(state: Column, n: Column) -> Column:
                return F.when(state["seg"] == n["seg"], state["tail"]).otherwise("")

            def step(state: Column, n: Column) -> Column:
                return F.struct(n["seg"].alias("seg"),
                                F.right(F.concat(tail(state, n), n["text"]), F.lit(V.PRECEDING_LIMIT)).alias("tail"))

            def emit(state: Column, n: Column) -> Column:
                short = n["text"].rlike(java(V.SHORT_DIGIT_NODE).replace("^", r"\A", 1))
                return F.struct(n["pos"].alias("pos"), n["parent"].alias("parent"), n["text"].alias("text"),
                                F.when(short, tail(state, n)).alias("preceding"))
            start = F.struct(F.lit(-1).alias("seg"), F.lit("").alias("tail"))
            return scan_fold(read, start, step, emit, TEXT_NODE)
        return let(body, lambda b: let(marks(b, F.size(ns)), lambda inside: let(
            marks(skip_roots(ns), F.size(ns)), lambda roots: with_roots(roots, inside, F.size(b) == 0))))
    return let(nodes, pick)


def has_keyword_trail(preceding: Column) -> Column:
    return preceding.rlike(java(V.KEYWORD_TRAIL, True))


def cross_node_match(text: Column, preceding: Column) -> Column:
    """Match of a lone number announced by a keyword in the text before its node."""
    trimmed = F.regexp_extract(text, java(r"^\s*(\d[\d \-]{2,14}\d)\s*$").replace("^", r"\A", 1), 1)
    start = F.length(F.regexp_extract(text, java(r"^(\s*)").replace("^", r"\A", 1), 1))
    return F.when(
        (trimmed != "") & has_keyword_trail(preceding),
        F.array(F.struct(
            start.cast("int").alias("start"), (start + F.length(trimmed)).cast("int").alias("end"),
            F.lit("numeric").alias("type"), F.lit("cross_node_keyword").alias("detector"),
            trimmed.alias("text"))))


def starts_tag(token: Column, name: str) -> Column:
    """Is the token a start tag of that name? Looks at its first characters only."""
    return F.left(token, F.lit(len(name) + 2)).rlike(rf"(?i)\A<{name}[\s/>]")


META = "struct<name:string,property:string,http_equiv:string,content:string>"


def metas(html: Column, found: Column | None = None) -> Column:
    """Meta tags in document order; none from comments, scripts or other raw text."""
    found = F.filter(tokens(html) if found is None else found, lambda t: starts_tag(t, "meta"))
    field = lambda m, name: F.coalesce(attribute(m, name), F.lit(""))
    return F.transform(found, lambda m: F.struct(
        field(m, "name").alias("name"), field(m, "property").alias("property"),
        field(m, "http-equiv").alias("http_equiv"), field(m, "content").alias("content")).cast(META))


def html_lang(html: Column, found: Column | None = None) -> Column:
    """The language the page's own html tag names."""
    tag = F.get(F.filter(tokens(html) if found is None else found, lambda t: starts_tag(t, "html")), F.lit(0))
    return F.coalesce(attribute(tag, "lang"), F.lit(""))


def body_sample(html: Column, found: Column | None = None) -> Column:
    """First characters of all text below the body, scripts and styles included, comments not.

    Tokens are read and references decoded until there are enough characters.
    """
    def text(t: Column) -> Column:
        plain = ~t.startswith("<") | (t == "<")
        raw = t.rlike(r"(?i)\A<(?:" + "|".join(V.RAW_TEXT_TAGS) + r")\b")
        held = F.when(plain, t).when(raw, F.regexp_extract(t, r"(?is)\A<[a-z]+\b[^>]*>(.*?)(?:</[a-z]+\s*>)?\z", 1)).otherwise("")
        return F.when((plain | t.rlike(r"(?i)\A<(?:textarea|title)\b")) & t.contains("&"), decode_entities(held)).otherwise(held)

    def sample(ts: Column) -> Column:
        body = F.coalesce(F.array_min(F.transform(ts, lambda t, i: F.when(starts_tag(t, "body"), i))), F.size(ts))
        inside = F.slice(ts, body + 2, F.greatest(F.size(ts) - body - 1, F.lit(0)))
        return F.aggregate(inside, F.lit(""), lambda got, t: F.when(
            F.length(got) < V.CURRENCY_SAMPLE, F.concat(got, text(t))).otherwise(got), lambda got: F.substring(got, 1, V.CURRENCY_SAMPLE))
    return let(tokens(html) if found is None else found, sample)


STEP_NODE = ("struct<pos:int,tag:string,head:string,parent:int,"
             "ancestors:array<int>,steps:array<string>,above:array<struct<depth:int,anc:int>>>")
_SLIM = "struct<pos:int,kind:string,tag:string,head:string>"
_ELEMENT = "struct<pos:int,tag:string,head:string,ancestors:array<int>>"
_STEP = "struct<pos:int,step:string>"


def ordered_steps(elements: Column) -> Column:
    """(pos, step) of every element: ``tag:nth-of-type(n)``, the how-manieth of its tag below its parent.

    Siblings of one tag meet by sorting, so neither many siblings nor many
    different tags below one parent are compared with one another.
    """
    siblings = F.sort_array(F.transform(elements, lambda e: F.struct(
        _parent(e["ancestors"]).alias("parent"), e["tag"].alias("tag"), e["pos"].alias("pos"))))

    def counted(ordered: Column) -> Column:
        def same(e: Column, before: Column) -> Column:
            return F.coalesce((before["parent"] == e["parent"]) & (before["tag"] == e["tag"]), F.lit(False))

        runs = F.transform(ordered, lambda e, i: F.struct(
            e["pos"].alias("pos"), e["tag"].alias("tag"), same(e, F.get(ordered, i - 1)).alias("same")))
        return F.sort_array(scan_fold(
            runs, F.lit(0), lambda nth, e: F.when(e["same"], nth + 1).otherwise(1), lambda nth, e: F.struct(
                e["pos"].alias("pos"), F.concat(e["tag"], F.lit(":nth-of-type("), nth.cast("string"), F.lit(")")).alias("step")),
            _STEP, emit_after=True))
    return let(siblings, counted)


def _parent(ancestors: Column) -> Column:
    return F.coalesce(F.try_element_at(ancestors, F.lit(-1)), F.lit(-1))


def element_tree(html: Column, names: Iterable[str], everywhere: Column) -> Column:
    """The elements of a page, placed as in :func:`tree`.

    ``head`` is the start tag where it holds attributes, ``steps`` the
    ``tag:nth-of-type(n)`` of every element on the way down, ``above`` the
    ancestors that hold one of the attributes ``names``, or all where ``everywhere``.
    """
    naming = rf"(?is)\s(?:{'|'.join(names)})\s*="

    def slim(token: Column, pos: Column) -> Column:
        head = F.when(token.contains("="), F.regexp_extract(token, r"(?s)\A<[^>]*>|\A.*?>", 0))
        return let(tag_name(token), lambda tag: F.struct(
            pos.alias("pos"), kind(token, tag).alias("kind"), tag.alias("tag"), head.alias("head")).cast(_SLIM))

    def emit(stack: Column, t: Column) -> Column:
        up = F.transform(stack, lambda s: s["pos"])
        return F.when(t["kind"] == "open", F.slice(up, F.lit(1), F.size(up) - 1)).when(t["kind"] != "close", up)

    def with_leaves(tags: Column) -> Column:
        """Elements that the next tag ends stand for both tags."""
        def leaf(t: Column, after: Column) -> Column:
            return (t["kind"] == "open") & (after["kind"] == "close") & (after["tag"] == t["tag"])

        seen = F.transform(tags, lambda t, i: F.struct(
            t["pos"].alias("pos"), F.when(leaf(t, F.get(tags, i + 1)), "leaf").otherwise(t["kind"]).alias("kind"),
            t["tag"].alias("tag"), t["head"].alias("head")))
        return let(seen, lambda ts: F.filter(ts, lambda t, i: (t["kind"] != "close") | F.coalesce(
            F.get(ts, i - 1)["kind"] != "leaf", F.lit(True))))

    def placed(tags: Column) -> Column:
        # texts and attributes stay out of the fold
        bare = F.transform(tags, lambda t: F.struct(t["pos"].alias("pos"), t["kind"].alias("kind"), t["tag"].alias("tag")))
        return let(scan_fold(bare, empty(_FRAME), _open_after, emit, "array<int>", emit_after=True), lambda ups: F.filter(
            F.transform(tags, lambda t, i: F.struct(
                t["pos"].alias("pos"), t["tag"].alias("tag"), t["head"].alias("head"), F.get(ups, i).alias("ancestors")).cast(_ELEMENT)),
            lambda e: e["ancestors"].isNotNull()))

    def with_steps(els: Column, size: Column) -> Column:
        named = marks(F.transform(F.filter(els, lambda e: e["head"].rlike(naming)), lambda e: e["pos"]), size)

        def above(e: Column, flags: Column) -> Column:
            return F.filter(F.transform(e["ancestors"], lambda a, i: F.struct(i.alias("depth"), a.alias("anc"))),
                            lambda x: everywhere | marked(flags, x["anc"]))

        def rows(steps: Column, flags: Column) -> Column:
            return F.transform(els, lambda e: F.struct(
                e["pos"].alias("pos"), e["tag"].alias("tag"), e["head"].alias("head"),
                _parent(e["ancestors"]).alias("parent"), e["ancestors"].alias("ancestors"),
                F.concat(F.transform(e["ancestors"], lambda a: F.get(steps, a)), F.array(F.get(steps, e["pos"]))).alias("steps"),
                above(e, flags).alias("above")).cast(STEP_NODE))
        steps = laid_out(ordered_steps(els), size, lambda x: x["step"], "string")
        return let(steps, lambda s: let(named, lambda flags: rows(s, flags)))

    return let(F.transform(tokens(html), slim), lambda ns: let(
        let(let(F.filter(ns, lambda n: n["tag"] != ""), with_leaves), placed), lambda els: with_steps(els, F.size(ns))))
