"""Pages as the DOM has them: references, raw text, signals, text before lone numbers."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import html


def value(spark, expr, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


@pytest.mark.parametrize("raw, text", [
    ("&#x41;&#65;&#X3a9;", "AAΩ"), ("&pound;5 &eacute &amp;lt; &lt;b&gt;", "£5 é &lt; <b>"), ("&notit; &notin; &unknown; &", "¬it; ∉ &unknown; &"),
    ("&#150;&#0;&#xD800;&#1114112;", "–���"), ("a & b &am &#; &#x;", "a & b &am &#; &#x;"), ("&NotEqualTilde;", "≂̸"), ("", ""),
])
def test_references(spark, raw, text):
    assert value(spark, html.decode_entities, raw) == [text]


def texts(spark, page):
    return [(r["text"], r["preceding"]) for r in value(spark, lambda h: html.text_nodes(html.tree(h)), page)[0]]


def test_raw_text_is_no_markup(spark):
    page = "<title>a <b>b</title><body><p>x</p><textarea><p>no</p></textarea><p>y</p></body>"
    assert [t for t, _ in texts(spark, page)] == ["x", "y"]


def test_the_shape_before_a_lone_number_is_tested_decoded(spark):
    got = texts(spark, "<body><p>Customer ID: <span>&nbsp;2024</span></p><p>99</p>tail <b>12&#51;4</b></body>")
    assert (" 2024", "Customer ID: ") in got and ("1234", "tail ") in got
    long = "<body><p>" + "w " * 100 + "<b>12345</b> <i>6789</i></p></body>"
    assert [p for t, p in texts(spark, long) if t in ("12345", "6789")] == [("w " * 100)[-120:], ("w " * 100 + "12345 ")[-120:]]


def test_signals_come_from_tokens(spark):
    page = ("<!-- <meta name=country content=fr><html lang=de> --><html lang=en><script>'<meta name=\"country\" content=\"es\">'</script>"
            "<meta name=country content=gb><body>£1<!-- £ --><script>var a='£'</script><style>£</style>&pound;</body>")
    assert [m["content"] for m in value(spark, html.metas, page)[0]] == ["gb"]
    assert value(spark, html.html_lang, page) == ["en"]
    assert value(spark, html.body_sample, page, "no body") == ["£1var a='£'££", ""]


def test_text_nodes_grow_with_the_page_alone(spark):
    import time
    took = []
    for n in (2000, 8000):
        df = spark.createDataFrame([("<body><table>" + "".join(f"<tr><td>{10000 + k}</td></tr>" for k in range(n)) + "</table></body>",)], "t string")
        start = time.time()
        assert df.select(F.size(html.text_nodes(html.tree(F.col("t"))))).first()[0] == n
        took.append(time.time() - start)
    assert took[1] < 12 * max(took[0], 0.5)


def test_numeric_references_of_any_length(spark):
    raw = "&#00000000065;&#x000000041;&#65&#x41;&#0;&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFF;&#x110000;&#128;&#x;&#;"
    assert value(spark, html.decode_entities, raw) == ["AAAA\ufffd\ufffd\ufffd\ufffd€&#x;&#;"]
