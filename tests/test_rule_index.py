"""Rules without a bound against the rules as literals."""

import random

from pyspark.sql import functions as F

from maskwright.functions import url as U
from maskwright.operators import policy

SCHEMA = "rule_ord int, hostname_value string, hostname_type string, snapshot string"


def corpus():
    rng = random.Random(2)
    hosts = ["a.com", "www.a.com", "x.www.a.com", "b.co.uk", "co.uk", "a.com.", "localhost", "aa.com", "com", ""]
    paths = ["", "/", "/*", "/en", "/en*", "/en/", "/en/*", "/en/p1", "/en/p1*", "/e*", "/\u00e9t\u00e9*", "/en/p1/"]
    schemes, ports = ["", "", "*://", "http://", "HTTPS://"], ["", "", "", ":8080", ":443"]
    rules = [(k, rng.choice(schemes) + rng.choice(["", "", "*."]) + rng.choice(hosts) + rng.choice(ports) + rng.choice(paths),
              rng.choice(["wildcard"] * 5 + ["exact", "regex", "glob"]), "{}") for k in range(120)]
    rules += [(500, "   ", "wildcard", "{}"), (501, "a.com", "wildcard", None)]
    urls = [f"{s}://{h}{p}{x}" for s in ("http", "https", "ftp") for h in hosts for p in ("", ":8080", ":443")
            for x in ("", "/", "/en", "/en/", "/en/p1", "/en/p1/", "/en/p12?q#f", "/\u00e9t\u00e9/1")]
    return rules, urls + [None, "", "no url", "mailto:x@a.com", "about:blank"] + urls[:40]


def test_index_equals_the_rules_one_by_one(spark):
    rules, urls = corpus()
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for first in (0, 40, 90):
        kept = policy.normalise_rules(spark.createDataFrame([r for r in rules if r[0] >= first], SCHEMA), max_rules=None)
        book = policy.RuleBook.of(kept)
        want = pages.select("page_id", book.wildcard_ord(U.url_parts(F.col("url"))).alias("rule_ord"))
        got = policy.index_match(pages, kept).select("page_id", "rule_ord")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_rules_no_pages_and_other_columns(spark):
    rules, urls = corpus()
    none = policy.normalise_rules(spark.createDataFrame([], SCHEMA), max_rules=None)
    pages = spark.createDataFrame([(1, "http://a.com/", 7)], "page_id long, url string, host int")
    assert [tuple(r) for r in policy.index_match(pages, none).select("page_id", "host", "rule_ord").collect()] == [(1, 7, None)]
    assert policy.index_match(pages.limit(0), policy.normalise_rules(spark.createDataFrame(rules, SCHEMA), max_rules=None)).count() == 0


def test_many_rules_of_one_host_meet_a_page_by_key(spark):
    rules = spark.range(20000).select(F.col("id").cast("int").alias("rule_ord"), F.concat(F.lit("hot.com/p"), "id", F.lit("*")).alias("hostname_value"),
                                      F.lit("wildcard").alias("hostname_type"), F.lit("{}").alias("snapshot"))
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.hot.com/p"), "id", F.lit("/x")).alias("url"))
    got = policy.index_match(pages, policy.normalise_rules(rules, max_rules=None))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    # the shortest prefix of the number that is a rule wins, as it comes first
    assert got.where("rule_ord <> int(substring(page_id, 1, 1))").count() == 0
