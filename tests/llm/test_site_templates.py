"""Main text: mark-up, templates counted per host, and odd input."""

import pytest

from maskwright.llm.site_templates import Page, extract_main_text


PROSE = " ".join(f"word{k}" for k in range(30))


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("plain  text", "plain text"),
    ("<p>a\n b<br>c<p>d", "a b c\nd"),
    ("<article><h1>T &amp; x</h1><p><b>one<br><p>two</article><footer>f</footer>", "T & x\none\ntwo"),
    ("<body><nav>menu</nav><p>kept</p><aside>side</aside><form>f</form></body>", "kept"),
    ("<main><p>x</p><div class='newsletter-box'>no</div><div class='content'>yes</div></main>", "x\nyes"),
    ("<article><p>x</p></article><section id=comments><article class=comment>c</article></section>", "x"),
    ("<article><p>x</p><article class='comment'>c</article></article>", "x"),
    ("<div class='comments-open'><article>x</article></div>", "x"),
    ("<article><header><h1>T</h1><p>by</p></header>x</article>", "T\nx"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes", "yes"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\n1 2\n3"),
    ("<p title='a>b'>x</p><p>cut <a href=", "x\ncut"),
    ("<p>&#x41;&eacute;&nbsp;&lt;b&gt; &am</p>", "Aé <b> &am"),
    ("<title>no</title><textarea><p>no</p></textarea><p hidden>no</p><p>yes</p>", "yes"),
    ("<nav>only</nav>", ""),
    ("<div id='header'>Site</div><div class='entry-header'><h1>T</h1></div><p>x</p><div class='author-bio'>by</div>", "T\nx\nby"),
    ("<div class='sideBar'>no</div><div class='ad-slot'>no</div><div class='leads'>x</div>", "x"),
    ("</p></div>x</article>", "x"),
    (f"<body><form><nav>menu</nav><h1>T</h1><p>{PROSE}</p><button>send</button></form></body>", f"T\n{PROSE}"),
    (f"<body><form><article><p>{PROSE}</p></article></form></body>", PROSE),
    (f"<div class='post share-box'><p>{PROSE}</p></div>", PROSE),
    (f"<div class='widget-content'><p>{PROSE}</p><div class='share-box'>Share this</div></div>", PROSE),
    (f"<div class='cookie-notice'><p>{PROSE}</p></div><p>x</p>", "x"),
    (f"<div id=comments><p>{PROSE}</p></div><p>x</p>", "x"),
    (f"<p>{PROSE}</p><form><p>{PROSE}</p></form>", PROSE),
    ("<form>search</form>", ""),
    (f"<{'x' * 80} hidden><p>no</p></{'x' * 80}><p>x</p>", "x"),
])
def test_text_of_a_page(html, text):
    assert Page(html).text(frozenset()) == text


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return sorted((tuple(r) for r in df.select("page_id", "text").collect()), key=str)


def test_subtrees_that_recur_on_a_host_go(spark):
    frame = "<div class=x1>Our offers <b>today</b></div><div class=x2>All rights</div>"
    rows = [(k, "http://a.example/p", f"<body>{frame}<div>Text number {k}</div></body>") for k in range(8)]
    rows += [(100 + k, f"http://b{k}.example/", f"<body>{frame}<div>Other {k}</div></body>") for k in range(8)]
    got = dict(texts(extract_main_text(pages_of(spark, rows))))
    assert all(got[k] == f"Text number {k}" for k in range(8))
    assert all(got[100 + k] == f"Our offers today\nAll rights\nOther {k}" for k in range(8))  # one page a host: nothing recurs


def test_prose_of_a_declared_article_stays_though_it_recurs(spark):
    rows = [(k, "http://a.example/p", f"<article><p>Licence line</p><p>Text {k}</p><div class=z>Box</div></article>") for k in range(8)]
    rows += [(50 + k, "http://c.example/p", "<article><div><p>One copy</p></div></article>") for k in range(9)]
    got = dict(texts(extract_main_text(pages_of(spark, rows))))
    assert all(got[k] == f"Licence line\nText {k}" for k in range(8))
    assert all(got[50 + k] == "One copy" for k in range(9))


def test_nulls_repeats_long_and_clashing_columns(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(None, None, None), (1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "x", ""), (3, "http://h/", long)]
    df = pages_of(spark, rows)
    clash = df.withColumn("key", df.url).withColumn("text", df.url).withColumn("version", df.url).withColumn("templates", df.url)
    for table in (df, clash):
        got = texts(extract_main_text(table))
        assert [x for x in got if x[0] != 3] == sorted([(None, ""), (1, "a"), (1, "a"), (2, "")], key=str)
        assert len(dict(got)[3]) == 5 * 200_000 - 1
    assert extract_main_text(df.limit(0)).count() == 0


def test_deep_nesting_and_many_quotes():
    assert Page("<div>" * 20_000 + "x").text(frozenset()) == "x"
    assert Page('<a "' * 3000 + ">x").text(frozenset()) is not None


def test_long_attributes_are_markup():
    long = "data:image/png;base64," + "QUJD>" * 20_000
    for q in "\"'":
        assert Page(f"<p>a<img src={q}{long}{q}>b</p>").text(frozenset()) == "ab"
        assert Page(f"<p>menu</p><article data-x = {q}{long}{q}><p>x</p></article>").text(frozenset()) == "x"
        assert Page(f"<nav data-x={q}{long}{q}>menu</nav><p>x</p>").text(frozenset()) == "x"
        assert Page(f"<p title={q}open>x</p><p>y</p>").text(frozenset()) == "x\ny"
    assert Page("<p>x</p><a title='<b>y</b>' ").text(frozenset()) == "x"
    assert Page("<a b='" * 20_001).text(frozenset()) is not None
    assert Page("<p title=it's>x</p><p>y's</p>").text(frozenset()) == "x\ny's"


def test_copies_of_a_page_do_not_hide_a_template(spark):
    page = "<body><div class=x1>Our offers</div><div>Text {}</div></body>"
    rows = [(k, "http://a.example/p", page.format(min(k, 7))) for k in range(60)]
    assert dict(texts(extract_main_text(pages_of(spark, rows)))) == {k: f"Text {min(k, 7)}" for k in range(60)}


def test_sections_of_a_large_host_have_templates(spark):
    rows = [(k, "http://a.example/p", f"<body>{'<div class=x1>Our offers</div>' if k % 4 == 0 else ''}<div>Text {k}</div></body>") for k in range(4000)]
    assert dict(texts(extract_main_text(pages_of(spark, rows)))) == {k: f"Text {k}" for k in range(4000)}


def test_prose_on_nearly_all_pages_of_a_host_goes_without_hiding_the_rest(spark):
    """Without templates the result is another one, for pages with a declared article and without."""
    line = "<p>Subscribe to our newsletter today</p>"
    rows = [(k, "http://a.example/p", f"<article><h1>T {k}</h1>{line}<p>Text {k}</p>{'<p>Often</p>' if k % 2 else ''}</article>") for k in range(40)]
    rows += [(100 + k, "http://b.example/p", f"<article>{line}<p>Text {k}</p></article>") for k in range(19)]
    rows += [(200 + k, "http://c.example/p", f"<body><div class=x>{line}</div><div><p>Text {k}</p></div></body>") for k in range(9)]
    got = dict(texts(extract_main_text(pages_of(spark, rows))))
    assert all(got[k] == f"T {k}\nText {k}" + ("\nOften" if k % 2 else "") for k in range(40))
    assert all(got[100 + k] == f"Subscribe to our newsletter today\nText {k}" for k in range(19))
    assert all(got[200 + k] == f"Text {k}" for k in range(9))


def test_templates_sent_and_joined_give_the_same(spark):
    rows = [(k, f"http://{'ab'[k % 2]}.example/{k % 30}", f"<body><div class=x{k % 2}>Our offers</div><div>Text {k % 30}</div></body>")
            for k in range(60)] + [(None, None, None), (99, None, "<p>x</p>")]
    sent, joined = (texts(extract_main_text(pages_of(spark, rows), most_sent=n)) for n in (100, 0))
    assert sent == joined and dict(sent)[3] == "Text 3" and dict(sent)[99] == "x"
