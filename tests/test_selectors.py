"""Selectors read as CSS reads them."""

from pyspark.sql import functions as F

from maskwright.operators import elements as E


def rows(spark, *bodies):
    df = spark.createDataFrame([(k, f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)], "page_id long, html string")
    return E.element_rows(df)


def found(spark, selectors, body):
    """Tag and place among its kind of the element that the first good selector finds."""
    target = rows(spark, body)
    stored = spark.createDataFrame([(0, 7, selectors)], "page_id long, item int, selectors array<string>")
    got = E.restore(stored, target).join(target.select("page_id", F.col("pos").alias("found"), "tag", "steps"), ["page_id", "found"]).collect()
    return [(r["steps"][-1], r["by_selector"]) for r in got]


def test_an_element_with_more_classes_matches_too(spark):
    assert found(spark, ["div.a"], "<div class='a'>1</div><div class='a b'>2</div>") == []
    assert found(spark, ["div.a"], "<p class='a'>0</p><div class='b a c'>2</div>") == [("div:nth-of-type(1)", 0)]
    assert found(spark, ["div.a.b"], "<div class='a'>1</div><div class='b a'>2</div>") == [("div:nth-of-type(2)", 0)]
    assert found(spark, ["#x > i.a"], "<i class=a></i><p id=x><i class='a z'></i></p>") == [("i:nth-of-type(1)", 0)]
    assert found(spark, ["div.md\\:w.\\31 st"], "<div class='md:w 1st'></div>") == [("div:nth-of-type(1)", 0)]


def test_the_first_selector_with_one_match_wins(spark):
    body = "<div id=a><p>1</p><p data-testid=q>2</p></div><span aria-label=z></span>"
    assert found(spark, ["div.gone", "span[aria-label=\"z\"]", "#a"], body) == [("span:nth-of-type(1)", 1)]
    assert found(spark, ["#a > p:nth-of-type(2)"], body) == [("p:nth-of-type(2)", 0)]
    assert found(spark, ["body > div:nth-of-type(1) > p:nth-of-type(1)"], body) == [("p:nth-of-type(1)", 0)]
    assert found(spark, ["[data-testid=\"q\"]"], body) == [("p:nth-of-type(2)", 0)]


def test_an_anchor_need_not_be_the_nearest(spark):
    body = "<div id=a><section id=b><p>1</p></section></div>"
    assert found(spark, ["#a > section:nth-of-type(1) > p:nth-of-type(1)"], body) == [("p:nth-of-type(1)", 0)]


def test_a_value_with_outer_spaces_gives_no_selector(spark):
    got = {r["tag"]: (r["by_data"], r["by_id"]) for r in E.id_selector(E.data_selector(
        rows(spark, "<p data-testid=' q '>1</p><b data-testid='r' id=' k '>2</b><i id=m>3</i>"))).collect()}
    assert got["p"] == (None, None) and got["b"] == ("[data-testid=\"r\"]", None) and got["i"] == (None, "#m")


def test_many_ids_and_classes_in_one_page(spark):
    body = "".join(f"<div id=i{k} class='c{k % 50} d'><p class='x y{k}'>t</p></div>" for k in range(3000))
    lists = E.selector_lists(rows(spark, body).cache()).where("tag = 'p'").select(F.size("selectors").alias("n")).collect()
    assert len(lists) == 3000 and {r["n"] for r in lists} == {3}


def test_no_side_of_elements_is_sent_whole(spark, tmp_path):
    rows(spark, "<div id=a class='x y'><p data-testid=q class=z>1</p><b aria-label=l>2</b></div>").write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    stored = E.selector_lists(kept).select("page_id", F.col("pos").alias("item"), "selectors")
    for df in (E.anchored_selector(kept), E.class_selector(kept), E.data_selector(kept), E.aria_selector(kept),
               E.id_selector(kept), E.restore(stored, kept)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_names_are_looked_up_only_where_they_may_stand(spark):
    body = "<main><div id=a><ul><li><b>1</b></li></ul></div><p class=c>2</p></main>"
    df = rows(spark, body)
    got = {r["tag"]: (r["named"], [a["anc"] for a in r["above"]]) for r in df.collect()}
    div = df.where("tag = 'div'").first()["pos"]
    assert got["b"] == got["li"] == got["ul"] == (False, [div])
    assert got["div"] == (True, []) and got["p"] == (True, []) and got["main"] == (False, [])
    lists = {r["tag"]: r["selectors"][1:] for r in E.selector_lists(df.cache()).collect()}
    assert lists["b"] == ["#a > ul:nth-of-type(1) > li:nth-of-type(1) > b:nth-of-type(1)"] and lists["main"] == [] and lists["p"] == ["p.c"]


def test_a_page_that_comes_twice_meets_the_names_of_both_copies(spark):
    pages = [(1, "<div><p>1</p></div>"), (1, "<div id=a><b>1</b></div>"), (2, "<div id=a><b>1</b></div>"), (None, "<div id=a><b>1</b></div>")]
    df = E.element_rows(spark.createDataFrame(pages, "page_id long, html string")).cache()
    assert {(r["page_id"], r["tag"], r["named"], len(r["above"])) for r in df.collect()} == {
        (1, "div", True, 0), (1, "p", True, 1), (1, "b", True, 1), (2, "div", True, 0), (2, "b", False, 1), (None, "div", True, 0), (None, "b", False, 1)}
    got = {(r["page_id"], r["tag"]): r["selectors"] for r in E.selector_lists(df).collect()}
    below = "#a > p:nth-of-type(1)"
    path = "body > b:nth-of-type(1)"
    assert got[1, "p"][-1] == below and got[1, "b"] == [path, below]  # the greatest path at that place
    assert got[2, "b"] == [path, "#a > b:nth-of-type(1)"] and got[None, "b"] == [path]


def test_pages_are_dealt_before_they_are_parsed(spark, tmp_path):
    spark.createDataFrame([(k, "<p>1</p>") for k in range(50)], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    df = E.element_rows(spark.read.parquet(str(tmp_path / "pages")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Generate") < plan.index("Exchange")  # the plan reads from its end
    assert df.select(F.spark_partition_id().alias("part")).distinct().count() > 1


def test_a_stored_selector_meets_every_answer_once(spark):
    target = rows(spark, "<ul><li>1</li><li>2</li></ul><i data-id=k>3</i><i data-id=k>4</i><b aria-label=z>5</b>")
    stored = spark.createDataFrame([(0, 1, ["[data-id=\"k\"]", None, "b[aria-label=\"z\"]"]), (0, 2, ["b[aria-label=\"z\"]"]),
                                    (0, None, ["b[aria-label=\"z\"]"]), (1, 3, ["b[aria-label=\"z\"]"]), (None, 4, ["b[aria-label=\"z\"]"])],
                                   "page_id long, item int, selectors array<string>")
    b = target.where("tag = 'b'").first()["pos"]
    got = {(r["page_id"], r["item"]): (r["found"], r["by_selector"]) for r in E.restore(stored, target).collect()}
    assert got == {(0, 1): (b, 2), (0, 2): (b, 0), (0, None): (b, 0)}
