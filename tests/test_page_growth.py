"""Large pages: right results, and costs that grow with the page and not with its square."""

import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions.arrays import laid_out, marks, scan_fold, with_once
from maskwright.operators import elements, html

c = F.col


def page(spark, body):
    return spark.createDataFrame([(1, "https://example.com/", f"<body>{body}</body>")], "page_id long, url string, html string")


def nodes(df):
    return with_once(df, nodes=html.tree(c("html")))


CASES = {
    "siblings": (lambda n: "<ul>" + "<li>x" * n + "</ul>", elements.element_rows),
    "tags": (lambda n: "".join(f"<x-{k}>t</x-{k}>" for k in range(n)), elements.element_rows),
    "code": (lambda n: "<p>t</p><pre><code>1</code></pre>" * (n // 3), lambda p: nodes(p).select(F.inline(html.text_nodes(c("nodes"))))),
    "cover": (lambda n: "<div>t<a>b</a></div>" * (n // 2), elements.mask_category_text),
    "changed": (lambda n: "<div>t<a>b</a></div>" * (n // 2), lambda p: nodes(p).select(F.explode(elements.top_nodes(
        c("nodes"), F.transform(c("nodes"), lambda x: x["pos"]))))),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cost_grows_with_the_page(spark, name):
    body, run = CASES[name]

    def seconds(n):
        best = None
        for _ in range(2):
            start = time.perf_counter()
            run(page(spark, body(n))).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            best = taken if best is None else min(best, taken)
        return best

    seconds(200)
    small, large = seconds(8_000), seconds(32_000)
    assert large < 15 and large < 2.3 ** 2 * max(small, 0.5)


def test_every_sibling_has_its_step(spark):
    rows = elements.element_rows(page(spark, "<ul>" + "<li>x<b></b>" * 3_000 + "</ul>")).select("tag", F.element_at("steps", -1).alias("step"))
    assert {r.step for r in rows.where("tag = 'li'").collect()} == {f"li:nth-of-type({k})" for k in range(1, 3_001)}
    assert {r.step for r in rows.where("tag = 'b'").collect()} == {"b:nth-of-type(1)"}


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1_024, 1_025, 40_000])
def test_folds_across_blocks(spark, n):
    xs = F.when(F.lit(n) > 0, F.sequence(F.lit(1), F.lit(max(n, 1)))).otherwise(F.expr("cast(array() as array<int>)"))
    made = spark.range(1).select(
        scan_fold(xs, F.lit(0).cast("long"), lambda s, x: s + x, lambda s, x: s * 10 + x % 10, "long").alias("before"),
        scan_fold(xs, F.lit(0).cast("long"), lambda s, x: s + x, lambda s, x: s, "long", emit_after=True).alias("after")).first()
    sums = [k * (k + 1) // 2 for k in range(n + 1)]
    assert made.after == sums[1:] and made.before == [sums[k] * 10 + (k + 1) % 10 for k in range(n)]


def test_marks_and_laid_out(spark):
    places = F.array(*map(F.lit, (5, 0, 5, 3)))
    row = spark.range(1).select(
        marks(places, F.lit(7)).alias("some"), marks(F.expr("cast(array() as array<int>)"), F.lit(2)).alias("none"),
        laid_out(F.expr("array(struct(1 as pos, 'a' as v), struct(3 as pos, 'b' as v))"), F.lit(5), lambda x: x["v"], "string").alias("laid")).first()
    assert row.some == [True, None, None, True, None, True, None] and row.none == [None, None] and row.laid == [None, "a", None, "b", None]
