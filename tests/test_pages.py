"""Pages: tokens, open elements, skip zones, lone numbers, addresses."""

from pyspark.sql import functions as F

from maskwright.functions.arrays import with_once
from maskwright.operators import elements, html, mask
from maskwright.plans.pages import scan_pages

c = F.col


def page(spark, *bodies):
    return spark.createDataFrame([(i, "https://example.com/", b) for i, b in enumerate(bodies)],
                                 "page_id long, url string, html string")


def texts(spark, body):
    rows = with_once(page(spark, body), nodes=html.tree(c("html"))).select(F.inline(html.text_nodes(c("nodes"))))
    return [r["text"] for r in rows.collect()]


def test_skip_zones(spark):
    assert texts(spark, "<body>a<code>1</code><kbd>2</kbd><pre>b</pre><pre class='lang-x'>3</pre><pre data-code>4</pre>"
                        "<pre>5<code>6</code></pre><div class=highlight><pre>7</pre></div><div class='q cm-editor'>8</div>"
                        "<!-- 9 --><noscript>10</noscript><script>'</p>'</script>c &amp; d</body>") == ["a", "b", "c & d"]


def test_unclosed_elements(spark):
    rows = with_once(page(spark, "<body><p>a<p>b<ul><li>c<li>d</ul><br>e"), nodes=html.tree(c("html"))).select(F.inline("nodes"))
    at = {r["token"]: r for r in rows.collect()}
    assert at["a"]["parent"] != at["b"]["parent"]
    assert len(at["c"]["ancestors"]) == len(at["d"]["ancestors"]) == 3
    assert len(at["e"]["ancestors"]) == 1


def test_lone_number_after_keyword(spark):
    got = scan_pages(page(
        spark,
        "<body><p><strong>Customer ID:</strong> <span>2024</span></p></body>",
        "<body><p>Customer ID:</p><p><span>2024</span></p></body>")).select("page_id", "hit", "detector").collect()
    assert [tuple(r) for r in got] == [(0, "2024", "cross_node_keyword")]


def test_tokens_join_to_page(spark):
    odd = ["a < b <c> 1 > 0", "<a title='x>y' b=\"z\">t", "<!-- open", "<script>never closed <p>", "", "plain", "<a href='q>"]
    rows = page(spark, *odd).select("html", F.array_join(html.tokens(c("html")), "").alias("j")).collect()
    assert all(r["html"] == r["j"] for r in rows)


def test_long_attribute_does_not_overflow(spark):
    big = "<img src='data:" + "A" * 300_000 + "'>tail"
    assert page(spark, big).select(F.size(html.tokens(c("html")))).first()[0] == 2


def test_cover(spark):
    body = ("<body><div>  <span></span></div><div>t</div><a><slot></slot></a><x-y>t</x-y><x-z></x-z><img>"
            "<div role=button></div><p></p></body>")
    got = with_once(page(spark, body), nodes=html.tree(c("html"))).select(
        F.inline(elements.covered(c("nodes"), ("text", "media", "structure", "form")))).collect()
    assert [(r["tag"], r["how"]) for r in got] == [
        ("div", "text"), ("a", "text"), ("x-y", "custom"), ("img", "always"), ("div", "role"), ("p", "always")]


def test_addresses(spark):
    body = ('<html><body><div id="a b"></div><div id="m"><span class="x y">1</span><span class="x">2</span></div>'
            '<i aria-label="say &quot;hi&quot;">3</i><b data-id="k">4</b></body></html>')
    rows = elements.selector_lists(elements.element_rows(page(spark, body))).collect()
    by = {r["pos"]: r["selectors"] for r in rows}
    spans = [s for r, s in sorted(by.items()) if any("span" in x for x in s)]
    assert spans[0] == ["body > div:nth-of-type(2) > span:nth-of-type(1)", "#m > span:nth-of-type(1)", "#m > span.x.y"]
    # The second span's class also fits the first, so it is not narrowed to the parent.
    assert spans[1][-1] == "span.x"
    assert any("[data-id=\"k\"]" in s for s in by.values())


def test_title_and_icon(spark):
    rows = page(spark, "<head><title>My bank</title></head>", '<head><title>x</title><link rel="icon" href="/f.ico"></head>') \
        .select(mask.title_redact(c("html")).alias("h")).collect()
    assert all("<title>Tab</title>" in r["h"] for r in rows)
    assert all(r["h"].count("data:image/png") == 1 for r in rows) and "/f.ico" not in rows[1]["h"]


def test_mask_ranges_clip(spark):
    nodes = spark.createDataFrame([(1, i, t) for i, t in enumerate(["hello ", "brave ", "world"])], "page_id int, node_id int, text string")
    ranges = spark.createDataFrame([(1, "r", 4, 14), (1, "empty", 3, 3)], "page_id int, range_id string, start int, end int")
    got = mask.mask_range(nodes, ranges).orderBy("node_id").collect()
    assert [r["masked"] for r in got] == ["hell**", "******", "**rld"]
