"""Checksums, dialect, URLs, country signals, settings."""

import re

from pyspark.sql import functions as F

from maskwright import values as V
from maskwright.functions import rx, url
from maskwright.functions import validators as C
from maskwright.operators import country, html, policy

c = F.col


def values(spark, check, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in df.select("i", check(c("x")).alias("v")).orderBy("i").collect()]


def test_checksums(spark):
    assert values(spark, C.luhn_ok, ["4242424242424242", "4242424242424243", "", "12a"]) == [True, False, False, False]
    assert values(spark, C.verhoeff_ok, ["2363", "2364", "3263", "", "23x3"]) == [True, False, False, False, False]
    assert values(spark, C.mod97_ok, ["GB29NWBK60161331926819", "GB30NWBK60161331926819", "gb29nwbk60161331926819", "GB2"]) \
        == [True, False, False, False]
    assert values(spark, C.isbn13_ok, ["9780135957059", "9780135957058", "978"]) == [True, False, False]
    assert values(spark, C.isbn10_ok, ["0201896834", "097522980X", "0201896835", "09752298"]) == [True, True, False, False]
    assert values(spark, C.iso7064_11_2_ok, ["11010519491231002X", "110105194912310020", "1"]) == [True, False, False]
    assert values(spark, lambda x: C.mod11_weighted(x, V.NHS_WEIGHTS), ["943476591", "12"]) == [299 % 11, -1]


def test_card_networks(spark):
    numbers = ["4242424242424242", "2221000000000009", "378282246310005", "6011000000000004", "6440000000000000", "30569309025904",
               "35280000000000070", "6200000000000005", "9999999999999999", "424242424242"]
    assert values(spark, C.card_network, numbers) == [
        "visa", "mastercard", "amex", "discover", "discover", "diners", "jcb", "unionpay", None, None]


def test_public_addresses(spark):
    ips = ["8.8.8.8", "10.0.0.1", "127.0.0.1", "169.254.1.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "224.0.0.1", "0.1.2.3",
           "1.2.3", "1.2.3.999"]
    assert values(spark, C.ipv4_public, ips) == [True, False, False, False, False, True, False, False, False, False, False]


def test_grouped_words_match_the_same():
    plain = re.compile(V.KEYWORD_ALT + r"(?![a-z])", re.I)
    fast = re.compile(rx.grouped(V.KEYWORDS_LONGEST_FIRST) + r"(?![a-z])", re.I)
    texts = ["user id", "user_id", "userid", "username", "access token", "accesstoken", "ref.no", "refnum", "reference", "identifier",
             "id", "no", "num", "confirmation number", "confirmation", "pins", "keys", "x", "policy-no", "api_secret"]
    for t in texts:
        a, b = plain.match(t), fast.match(t)
        assert (a and a.group()) == (b and b.group()), t


def test_presence_patterns_agree(spark):
    words = ["Seite 4", "me GUSTA", "office", "nothing", "コメント", "VERFÜGBAR", "cart", "scart", "carts", "/month", "Preis", "कीमत",
             "étoiles", "ÉVALUATION", "per  month"]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    for p in (V.COUNT_NOISE, V.PUBLIC_PRICE):
        assert df.where(c("x").rlike(rx.java(p, True)) != c("x").rlike(rx.finds(p))).count() == 0


def test_url_patterns(spark):
    cases = [
        ("https://sub.example.com/a", "example.com", True), ("https://notexample.com/", "example.com", False),
        ("https://example.com/", "*.example.com", False), ("https://a.example.com/", "*.example.com", True),
        ("http://example.com:8080/x", "example.com:8080", True), ("http://example.com/x", "example.com:8080", False),
        ("http://example.com/", "https://example.com", False), ("https://example.com/app/1", "example.com/app*", True),
        ("https://example.com/ap", "example.com/app*", False), ("https://example.com/app/", "example.com/app", True),
        ("https://EXAMPLE.com", "*://example.com/*", True), ("not a url", "example.com", False),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, u string, p string, want boolean")
    got = df.select("u", "p", "want", url.wildcard_match(url.url_parts(c("u")), url.parse_pattern(c("p"))).alias("got"))
    assert [tuple(r) for r in got.where("want <> got").collect()] == []


def test_restricted(spark):
    urls = ["chrome://settings", "about:blank", "https://chromewebstore.google.com/x", "https://chrome.google.com/webstore/a",
            "https://chrome.google.com/other", "https://example.com", "", None, "nonsense"]
    assert values(spark, url.restricted, urls) == [True, True, True, True, False, False, True, True, True]


def test_unsafe_regexes():
    assert not policy.regex_allowed("(a+)+")
    assert not policy.regex_allowed("[unclosed")
    assert not policy.regex_allowed("a++")
    assert not policy.regex_allowed("x" * 501)
    assert policy.regex_allowed(r"^https://(www|blog)[.]example")


def test_country(spark):
    assert values(spark, country.country_lang, ["en-US", "zh-Hant-TW", "en", "en_gb", "", "EN-US"]) == ["US", "TW", None, "GB", None, None]
    assert values(spark, country.country_tld, ["amazon.co.uk", "amazon.com", "localhost", "a.DE"]) == ["GB", None, None, "DE"]
    assert values(spark, country.country_currency, ["£1 £2 £3", "£1 £2", "₹₹₹££££", "£££₹₹₹"]) == ["GB", None, "GB", "GB"]
    pages = ['<meta name="geo.country" content=" gb "><meta property="og:locale" content="nl_NL">',
             '<META HTTP-EQUIV=Content-Language CONTENT="en-US">', '<meta name="country" content="xyz">', '<p>']
    assert values(spark, lambda h: country.country_meta(html.metas(h)), pages) == ["GB", "US", None, None]


def test_settings_repair(spark):
    docs = ['{"settings":{"blur_radius":99,"reveal_mode":"click"},"blur_all":{"settings":{"blur_mode":"masked"}},'
            '"auto_detect_pii":{"settings":{"email":"yes","pii_mode":"hidden"}},'
            '"automate":{"settings":{"idle":{"value":5,"unit":"sec"}}}}', "broken"]
    rows = policy.load(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, settings string")).orderBy("i").collect()
    first = rows[0]
    assert (first["blur_radius"], first["reveal_mode"], first["blur_mode"]) == (8.0, "click", "censored")
    assert (first["pii_email"], first["pii_mode"], first["idle_value"]) == (False, "starred", 15.0)
    assert {k: rows[1][k] for k in policy.DEFAULTS} == policy.DEFAULTS


def test_rule_cap(spark):
    rules = spark.range(300).selectExpr(
        "CAST(id AS INT) rule_ord", "IF(id % 50 = 0, ' ', concat('h', id, '.com')) hostname_value", "'odd' hostname_type", "'{}' snapshot")
    kept = policy.normalise_rules(rules)
    assert kept.count() == 200 and kept.select("hostname_type").distinct().first()[0] == "wildcard"
    assert len(policy.RuleBook.of(kept).rules) == 200
