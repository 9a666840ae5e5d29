"""Main text of pages: site templates found by counting element subtrees per host.

Every block element of a page is hashed with all below it. A subtree that
recurs under enough different parents on one host is part of the site's
template and is cut out, with what mark-up itself declares as frame: menus,
headers, footers, sidebars, forms, notices, adverts, comments. Prose of a
declared article must recur on nearly all pages of its host to go. A form, or
an element with a name like ``share-box``, that holds the page's prose is a
wrapper and no frame. What is left of the declared article (or of the body,
without one) is the text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .link_trust import host_path
from .shared import arrow_map, stored

#: A quote opens a value after ``=`` only, and one that is never closed stands for itself.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|(?P<open>\Z))", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW = re.compile(r"script|style|noscript|template|iframe|noembed|noframes|title|textarea|svg|math|xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre
search section select summary table tbody tfoot thead tr ul""".split())
#: Elements that an opening tag closes: what may not nest in itself, up to a border.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "body": ("head",)}
BORDER = frozenset("ul ol dl table menu select html body article main section div blockquote".split())
FRAME = frozenset("head nav aside footer form button select menu dialog object".split())
FRAME_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar".split())
FRAME_NAME = frozenset("""ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs
captcha comment comments commentlist consent cookie cookies copyright discussion disqus donate footer gdpr login
masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup
promo promotion promoted recommended recommendations related replies reply respond search share sharing sidebar signin
signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets""".split())
#: Of these, words that wrappers of a whole article also carry.
WRAPPER_NAME = frozenset("""banner masthead menu modal navbar overlay popup search share sharing social toolbar topbar
widget widgets""".split())
#: Whole names of a site's header; other names with the word often hold an article's title.
HEADER_NAME = frozenset("header site-header siteheader main-header top-header global-header page-top".split())
#: Class names of an article element that is not the page's own.
OTHER_ARTICLE = frozenset("comment comment-body related teaser ad advert promo sponsored widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose text is taken for the article's own inside a declared article, unless nearly all pages have it.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd figcaption caption tr td th summary".split())
#: Elements whose text is a label of the frame, not prose.
LABEL = frozenset("a button label option legend".split())
#: A wrapper holds this many words of prose at least, and this share of the page's; with a main heading the smaller one.
WRAPPER_WORDS, WRAPPER_SHARE, HEADED_SHARE = 20, 0.9, 0.5
#: In-article prose has hashes of its own, so its templates are not those of other elements.
PROSE_MARK = 0x5DEECE66D
#: Templates of a corpus, at 16 bytes each, that are sent to all workers; beyond it pages and templates are joined.
BROADCAST_TEMPLATES = 400_000
#: Class names that tell a state of the page rather than what the element is.
STATE = re.compile(r"^(no|has|with|without|is)[-_]|[-_](open|opened|closed|enabled|disabled|on|off)$", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _closer(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


_CLOSERS: dict[str, re.Pattern] = {}


class Page:
    """Elements of a page in document order, and its texts and block borders."""

    def __init__(self, source: str):
        self.tag, self.parent, self.name, self.frame = ["#root"], [-1], [""], [False]
        self.maybe: list[int] = []
        self.parts: list[list] = [[]]
        self.events: list[tuple[int, str | None]] = []
        self._parse(source)
        self._unwrap()

    def _open(self, tag: str, attrs: str, at: int) -> int:
        names, role, hidden = [], "", False
        for m in ATTR.finditer(attrs) if attrs.strip(" /") else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                role = value.lower().strip()
            elif key == "hidden":
                hidden = True
            else:
                names.append(value)
        frame, maybe = tag in FRAME or role in FRAME_ROLE or hidden, tag == "form" and not hidden
        if names and not frame and tag == "article":
            frame = any(w.lower() in OTHER_ARTICLE for value in names for w in value.split())
        elif names and not frame and tag not in ("html", "body", "main"):
            found = {w.lower() for value in names for name in value.split()
                     if not STATE.search(name) for w in WORDS.findall(name)} & FRAME_NAME
            whole = {name.replace("-", "").replace("_", "") for value in names for name in value.lower().split()}
            header = any(name in HEADER_NAME for value in names for name in value.lower().split())
            frame = bool(found or header or whole & FRAME_NAME)
            maybe = frame and not header and (found | whole & FRAME_NAME) <= WRAPPER_NAME
        self.tag.append("main" if role == "main" else tag)
        self.parent.append(at)
        self.name.append("|".join(names))
        self.frame.append(frame)
        if frame and maybe:
            self.maybe.append(len(self.tag) - 1)
        self.parts.append([])
        self.parts[at].append(len(self.tag) - 1)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        stack, pos, size = [0], 0, len(source)
        text = self._text
        while pos < size:
            m = TOKEN.search(source, pos)
            if not m or m["open"] is not None:
                rest = source[pos:]
                cut = m if m and ">" in m[0] else re.compile(r"<[!/?A-Za-z][^<]*\Z").search(source, pos)
                text(stack[-1], rest[:cut.start() - pos] if cut else rest)
                break
            if m.start() > pos:
                text(stack[-1], source[pos:m.start()])
            pos = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                self._close(stack, tag)
                continue
            if tag in BLOCK:
                self.events.append((stack[-1], None))
                self._imply(stack, tag)
            elif tag in CLOSES:
                self._imply(stack, tag)
            if tag == "br" or tag in ("td", "th"):
                self.events.append((stack[-1], " "))
            if RAW.fullmatch(tag):
                if not m["attrs"].endswith("/") or tag not in ("svg", "math"):
                    closer = _CLOSERS.setdefault(tag, _closer(tag)).search(source, pos)
                    pos = closer.end() if closer else size
                continue
            if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCK:
                continue
            stack.append(self._open(tag, m["attrs"], stack[-1]))
        self.events.append((0, None))

    def _text(self, at: int, raw: str) -> None:
        value = entities.unescape(raw) if "&" in raw else raw
        self.events.append((at, value))
        value = " ".join(value.split())
        if value:
            self.parts[at].append(value)

    def _imply(self, stack: list[int], tag: str) -> None:
        """Close what the opening tag cannot stand in."""
        for closed in CLOSES.get(tag, ()) + (("p",) if tag in BLOCK and tag not in ("html", "body", "head") else ()):
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name == closed:
                    del stack[k:]
                    if closed in BLOCK:
                        self.events.append((stack[-1], None))
                    break
                if name in BORDER:
                    break

    def _close(self, stack: list[int], tag: str) -> None:
        if tag in BLOCK:
            self.events.append((stack[-1], None))
        for k in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[k]]
            if name == tag or tag == "main" and name == "main":
                del stack[k:]
                return
            if tag not in BLOCK and name in BLOCK:
                return

    def _unwrap(self) -> None:
        """What may be frame or wrapper is no frame where it holds the page's prose."""
        if not self.maybe:
            return
        sure = list(self.frame)
        for k in self.maybe:
            sure[k] = False
        dumb = self._below([a or t in LABEL for a, t in zip(sure, self.tag)])
        words = [0 if dumb[k] else sum(len(x.split()) for x in self.parts[k] if isinstance(x, str))
                 for k in range(len(self.tag))]
        headed = [t == "h1" and not dumb[k] for k, t in enumerate(self.tag)]
        for k in range(len(self.tag) - 1, 0, -1):
            words[self.parent[k]] += words[k]
            headed[self.parent[k]] = headed[self.parent[k]] or headed[k]
        for k in self.maybe:
            least = HEADED_SHARE if headed[k] else WRAPPER_SHARE
            if words[k] >= max(WRAPPER_WORDS, least * words[0]):
                self.frame[k] = False

    def hashes(self) -> list[int]:
        """A 64-bit hash of every element with all that stands below it."""
        out = [0] * len(self.tag)
        for k in range(len(self.tag) - 1, -1, -1):
            digest = hashlib.blake2b(f"{self.tag[k]}|{self.name[k]}".encode("utf-8", "replace"), digest_size=8)
            for part in self.parts[k]:
                digest.update(part.encode("utf-8", "replace") + b"\x00" if isinstance(part, str)
                              else out[part].to_bytes(8, "little", signed=True))
            out[k] = int.from_bytes(digest.digest(), "little", signed=True)
        return out

    def roots(self) -> list[int]:
        """Declared articles, else declared main parts, that are no frame; empty where the body is all there is."""
        gone = self._below(self.frame)
        for reachable in (gone, self._below([t in FRAME and f for t, f in zip(self.tag, self.frame)])):
            for name in ("article", "main"):
                found = [k for k, t in enumerate(self.tag) if t == name and not reachable[k]]
                if found:
                    return found
        return []

    def inside(self) -> list[bool]:
        """For every element, whether it stands in a declared article."""
        marked = [False] * len(self.tag)
        for k in self.roots():
            marked[k] = True
        return self._below(marked)

    def _below(self, marked: list[bool]) -> list[bool]:
        out = list(marked)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out

    def subtrees(self) -> Iterator[tuple[int, int, int, bool]]:
        """(element, hash, parent's hash, whether prose of an article) of what a template may hold."""
        inside, made = self.inside(), self.hashes()
        for k in range(1, len(self.tag)):
            tag = self.tag[k]
            if tag not in BLOCK or tag in ("html", "body", "main", "article", "head") or not self.parts[k]:
                continue
            prose = inside[k] and tag in PROSE
            yield k, made[k] ^ PROSE_MARK if prose else made[k], made[self.parent[k]], prose

    def text(self, templates: frozenset[int]) -> str:
        """Blocks of the main text, one a line."""
        inside, cut = self.inside(), list(self.frame)
        for k, made, *_ in self.subtrees() if templates else ():
            cut[k] = cut[k] or made in templates
        only, gone, head = any(inside), [False] * len(self.tag), [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            up = self.parent[k]
            if inside[k] and not inside[up]:  # an article starts: what stands around it does not count
                continue
            head[k] = self.tag[k] == "header" and inside[k] or head[up]
            heading = self.tag[k] in HEADINGS
            gone[k] = cut[k] or gone[up] and not (heading and head[up]) or self.tag[k] == "header"
        blocks, now = [], []
        for at, value in self.events:
            if value is None:
                line = " ".join("".join(now).split())
                if line:
                    blocks.append(line)
                now = []
            elif not gone[at] and (inside[at] or not only):
                now.append(value)
        return "\n".join(blocks)


def _subtree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, sources = (batch.column(i).to_pylist() for i in range(2))
        out: list[list] = [[], [], [], []]
        for host, source in zip(hosts, sources):
            for made, parent, prose in {row[1:] for row in Page(source or "").subtrees()}:
                for column, value in zip(out, (host, made, parent, prose)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
            ["host", "made", "parent", "prose"])


def _found_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, made) of every different subtree."""
    for batch in batches:
        pages, hosts, sources = (batch.column(i).to_pylist() for i in range(3))
        rows = [(page, host, made) for page, host, source in zip(pages, hosts, sources)
                for made in {row[1] for row in Page(source or "").subtrees()}]
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], pa.int64()) for i in range(3)],
                                         ["page", "host", "made"])


def _text_batch(batch: pa.RecordBatch, templates_of) -> pa.RecordBatch:
    keys, urls, sources, last = (batch.column(i).to_pylist() for i in range(4))
    texts = [Page(source or "").text(templates_of(x)) for source, x in zip(sources, last)]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(urls, pa.string()),
                                       pa.array(texts, pa.string())], ["key", "url", "text"])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _text_batch(batch, lambda found: frozenset(found or ()))


def site_templates(subtrees: DataFrame, pages_of: DataFrame, min_pages: int, share: float, enough: int,
                   prose_pages: int, prose_share: float) -> DataFrame:
    """(host, made): subtrees under at least ``min_pages`` different parents and ``share`` of the host's pages, or ``enough``.

    Prose of articles: at least ``prose_pages`` different parents and ``prose_share`` of the pages.
    """
    counts = subtrees.distinct().groupBy("host", "made", "prose").agg(F.count("*").alias("n"))
    counts = counts.where(F.col("n") >= F.when(F.col("prose"), prose_pages).otherwise(min_pages))
    least = F.when(F.col("prose"), prose_share * F.col("pages")).otherwise(
        F.least(share * F.col("pages"), F.lit(enough)))
    return counts.join(pages_of, "host").where(F.col("n") >= least).select("host", "made")


def _with_sent(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Texts, the templates at hand in every worker, ordered by host: no page is shuffled."""
    table = templates.orderBy("host", "made").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(
        (table["host"].to_numpy().astype(np.int64), table["made"].to_numpy().astype(np.int64)))

    def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, made = sent.value
        for batch in batches:
            known: dict[int, frozenset[int]] = {}

            def templates_of(host: int) -> frozenset[int]:
                if host not in known:
                    first, end = np.searchsorted(hosts, host, "left"), np.searchsorted(hosts, host, "right")
                    known[host] = frozenset(made[first:end].tolist())
                return known[host]
            yield _text_batch(batch, templates_of)
    return arrow_map(rows.select("key", "url", "html", "host"), text_rows, "key long, url string, text string")


def _with_joined(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Texts, every page joined with the templates that it holds."""
    page = F.xxhash64("url", "html")
    held = arrow_map(rows.select(page.alias("page"), "host", "html"), _found_rows,
                     "page long, host long, made long")
    found = held.join(templates, ["host", "made"]).groupBy("page").agg(F.collect_set("made").alias("templates"))
    joined = rows.withColumn("page", page).join(found, "page", "left")
    return arrow_map(joined.select("key", "url", "html", "templates"), _text_rows, "key long, url string, text string")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      min_pages: int = 5, share: float = 0.3, enough: int = 1000, prose_pages: int = 20,
                      prose_share: float = 0.8, most_sent: int = BROADCAST_TEMPLATES) -> DataFrame:
    """(page_id, url, text) for every row.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by ``\\n`` in page order. A null or empty html, or
    one that holds frame only, gives an empty text. Prose inside a declared
    article goes if it stands in at least ``prose_pages`` different articles and
    ``prose_share`` of the host's pages; other subtrees from ``min_pages`` and
    ``share`` on, or ``enough`` pages of a large host. Pages of a host with fewer
    than ``min_pages`` pages lose only what the mark-up declares as frame. Copies
    of a page count once, among the pages of a host as well as where a subtree
    recurs. Up to ``most_sent`` templates are sent to the workers; more are
    joined with the pages, with the same result. Rows that repeat a page are
    extracted each, so there are no ties to settle; only the three named columns
    are read, others are not carried along. A page is parsed in one row, however
    long; an empty table gives an empty table.
    """
    host = host_path(F.col(url_col))[0]
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"), F.xxhash64(host).alias("host"))
    subtrees = arrow_map(rows.select("host", "html"), _subtree_rows, "host long, made long, parent long, prose boolean")
    kinds = rows.select("host", F.xxhash64("html").alias("content")).distinct()
    pages_of = kinds.groupBy("host").agg(F.count("*").alias("pages"))
    templates = stored(site_templates(subtrees, pages_of, min_pages, share, enough, prose_pages, prose_share), "templates")
    few = templates.count() <= most_sent
    return (_with_sent if few else _with_joined)(rows, templates).withColumnRenamed("key", "page_id")
