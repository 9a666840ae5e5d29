"""Rule regexes, URL parts, context gates and kept expressions."""

import pytest
from pyspark.sql import functions as F

from maskwright import values as V
from maskwright.functions import url as U
from maskwright.functions.rx import java
from maskwright.operators import detect, policy, resolve


@pytest.mark.parametrize("pattern, allowed, text, found", [
    ("(?P<x>a)", False, "a", None), ("(?<h>example)", True, "example.com", True), ("[[:alpha:]]", True, "x", False),
    ("[[:alpha:]]", True, "l]", True), ("[^]", True, "\n", True), ("[]", True, "a", False), ("[a&&b]", True, "&", True),
    ("a++", False, "a", None), ("(?i)a", False, "a", None), ("[unclosed", False, "u", None), ("(?>a)", False, "a", None),
    (r"\qx", True, "qx", True), ("x{2}", True, "xx", True), ("a)", False, "a", None), ("[*+?]{2}", True, "+*", True),
])
def test_rule_regexes_follow_ecmascript(spark, pattern, allowed, text, found):
    assert policy.regex_allowed(pattern, spark) is allowed
    if allowed:
        assert spark.range(1).select(F.lit(text).rlike(java(pattern, True))).first()[0] is found


def rules_of(spark, values):
    return spark.createDataFrame([(k, v, t, "{}") for k, (v, t) in enumerate(values)],
                                 "rule_ord int, hostname_value string, hostname_type string, snapshot string")


def test_no_rule_ends_a_job_and_none_is_refused(spark):
    rules = rules_of(spark, [("(?P<x>a)", "regex"), ("(?<h>example)", "regex")] + [(f"h{k}.org", "wildcard") for k in range(300)])
    book = policy.RuleBook.of(rules)
    urls = spark.createDataFrame([("https://example.com/",), ("https://x.h299.org/",), ("https://b.com/",)], "url string")
    assert [r[0] for r in urls.select(book.first_match(F.col("url"))).collect()] == [1, 301, None]
    assert policy.normalise_rules(rules).count() == V.MAX_RULES
    assert policy.normalise_rules(rules, max_rules=250).count() == 250


@pytest.mark.parametrize("url, parts", [
    ("https:/www.example.com/x", ("https", "www.example.com", "", "/x")), ("https:host/x", ("https", "host", "", "/x")),
    ("http:\\\\a.com\\b", ("http", "a.com", "", "/b")), ("http:///x.com/y", ("http", "x.com", "", "/y")),
    ("http://ex%61mple.com./a", ("http", "example.com.", "", "/a")), ("HTTP://U@Ex.com:80?q", ("http", "ex.com", "", "/")),
    ("http://[::1]:8080/x", ("http", "[::1]", "8080", "/x")), ("mailto:a@b.c", ("mailto", "", "", "a@b.c")),
    ("chrome:/x/y", ("chrome", "", "", "/x/y")), ("http://", None), ("no url", None),
])
def test_url_parts(spark, url, parts):
    got = spark.range(1).select(U.url_parts(F.lit(url)).alias("p")).first()["p"]
    assert (tuple(got) if got else None) == parts


def test_a_country_alone_passes_the_gate(spark):
    df = spark.createDataFrame([("Badge 123-45-6789 printed.", "US")], "text string, country string")
    ids = tuple(d.id for d in detect.catalogue() if not d.dispositive)
    shapes = df.select(F.explode(detect.extract(F.col("text"), F.lit(None).cast("string"), False, True, only=ids, context=False)).alias("h"))
    assert "ssn_us" in [r[0] for r in shapes.select(detect.detector_name(F.col("h.rank"))).collect()]
    assert "ssn_us" in [m["detector"] for m in resolve.with_matches(df).first()["m"]]


def test_a_detector_registered_anew_is_not_served_from_the_old_one(spark):
    df = spark.createDataFrame([("code QQ12 and ZZ34",)], "text string")
    found = []
    for pattern in (r"\bQQ\d{2}\b", r"\bZZ\d{2}\b"):
        detect.register_detector(V.Detector("mine", pattern, 1, dispositive=True))
        try:
            found.append([m["text"] for m in df.select(resolve.scan("text").alias("m")).first()["m"] if m["detector"] == "mine"])
        finally:
            detect.unregister_detector("mine")
    assert found == [["QQ12"], ["ZZ34"]]


def test_a_rule_that_sets_one_field_leaves_the_others_to_the_globals(spark):
    base = {n: policy._default(n) for n in policy.DEFAULTS} | {"blur_radius": F.lit(10.0), "reveal_mode": F.lit("tap"), "pii_mode": F.lit("starred")}
    one = '{"auto_detect_pii": {"settings": {"email": true}}}'
    df = spark.createDataFrame([(one,), ("{}",), (None,)], "snapshot string")
    got = [r[0] for r in df.select(policy.merge_snapshot(F.col("snapshot"), base)).collect()]
    assert [(r.pii_email, r.pii_mode, r.blur_radius, r.reveal_mode) for r in got] == [
        (True, "starred", 10.0, "tap"), (False, "starred", 10.0, "tap"), (False, "starred", 10.0, "tap")]
