"""Text to spans: one row per case, all scanned in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright import values as V
from maskwright.operators import detect, mask, resolve

JWT = "eyJ" + "a1B2c3D4e5F6" + "." + "q" * 11 + "7." + "z" * 12
POSITIVE = [
    ("card_pan", "Charge to 4242424242424242 today.", "4242424242424242", None),
    ("card_pan", "Try 5555-5555-5555-4444 now.", "5555-5555-5555-4444", None),
    ("card_pan", "Use 378282246310005 here.", "378282246310005", None),
    ("iban", "Wire to GB29 NWBK 6016 1331 9268 19 today.", "GB29 NWBK 6016 1331 9268 19", None),
    ("iban", "DE89370400440532013000", "DE89370400440532013000", None),
    ("aadhaar", "Aadhaar 234123412346 on file.", "234123412346", None),
    ("cn_id", "id 11010519491231002X", "11010519491231002X", None),
    ("nric_sg", "S1234567A", "S1234567A", None),
    ("curp_mx", "HEGG560427MVZRRL04", "HEGG560427MVZRRL04", None),
    ("emirates_id", "784-1985-1234567-8", "784-1985-1234567-8", None),
    ("nie_es", "X1234567L", "X1234567L", None),
    ("codice_fiscale", "RSSMRA80A01H501Z", "RSSMRA80A01H501Z", None),
    ("postal_uk", "SW1A 1AA", "SW1A 1AA", None),
    ("postal_ca", "K1A 0B1", "K1A 0B1", None),
    ("ipv6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", None),
    ("gps_dms", "40°26'46\"N", "40°26'46\"N", None),
    ("plus_code", "8FVC9G8F+5W", "8FVC9G8F+5W", None),
    ("mac_address", "NIC 00:1A:2B:3C:4D:5E booted.", "00:1A:2B:3C:4D:5E", None),
    ("imei", "IMEI 490154203237518 ok", "490154203237518", None),
    ("ssn_us", "SSN 123-45-6789 on file.", "123-45-6789", None),
    ("ssn_us", "Badge 123-45-6789 on file.", "123-45-6789", "US"),
    ("nhs_uk", "Patient 943 476 5919 record.", "943 476 5919", None),
    ("bsn_nl", "BSN 111222333 op formulier.", "111222333", None),
    ("npi_us", "NPI 1234567893 on claim.", "1234567893", None),
    ("dni_es", "DNI 12345678Z", "12345678Z", "ES"),
    ("abn_au", "ABN 51 824 753 556", "51 824 753 556", None),
    ("mrn", "Patient MRN 12345 record.", "12345", None),
    ("e164_phone", "Reach +919876543210 today.", "+919876543210", None),
    ("numeric_generic", "(555) 123-4567", "(555) 123-4567", None),
    ("numeric_generic", "Hello $1,234.56, world done.", "$1,234.56", None),
    ("numeric_generic", "Budget: $17k", "$17", None),
    ("numeric_generic", "792-792", "792-792", None),
    ("numeric_generic", "20269999", "20269999", None),
    ("numeric_generic", "é1234567 accents", "1234567", None),
    ("numeric_generic", "\U0001F600 call 555 1234567", "555 1234567", None),
    ("keyword_value", "api_key: abc123def456ghi", "abc123def456ghi", None),
    ("keyword_value", "token=\"abc123def456\" next", "abc123def456", None),
    ("keyword_value", "password is hunter2hunter2", "hunter2hunter2", None),
    ("secret_token", "AKIA" + "A1B2C3D4E5F6G7H8", "AKIA" + "A1B2C3D4E5F6G7H8", None),
    ("secret_token", "see ghp_" + "a1" * 18, "ghp_" + "a1" * 18, None),
    ("secret_token", JWT, JWT, None),
    ("email", "mail a.b@c.de now", "a.b@c.de", None),
]
NEGATIVE = [
    "SSN 000-12-3456", "9780135957059", "10.0.0.1 server", "1920x1080", "1024 MB", "2020-2024", "#123456", "12345%",
    "1234e10", "v17150", "17150.3", "Section 12345", "2026-04-29", "20260429", "Order #12345", "The price 12345",
    "12345 unread messages", "n=15234 near p<0.05", "password: hunter2", "no digits at all", "abc", "",
    "key: aaaaaaaaaaaa", "token: abcdefghijklmnop",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, k) for i, (_, t, _, k) in enumerate(POSITIVE)]
    rows += [(1000 + i, t, None) for i, t in enumerate(NEGATIVE)]
    df = spark.createDataFrame(rows, "id int, text string, country string")
    return {r["id"]: r for r in resolve.with_matches(df).select("id", "text", "m").collect()}


def test_positive(found):
    for i, (detector, text, span, _) in enumerate(POSITIVE):
        hits = [(m["detector"], m["text"]) for m in found[i]["m"]]
        assert (detector, span) in hits, (text, hits)


def test_offsets(found):
    for r in found.values():
        for m in r["m"]:
            assert r["text"][m["start"]:m["end"]] == m["text"]


def test_negative(found):
    for i, text in enumerate(NEGATIVE):
        hits = [m["text"] for m in found[1000 + i]["m"]]
        if text.startswith("SSN 000"):
            assert all(m["detector"] != "ssn_us" for m in found[1000 + i]["m"])
        elif text == "n=15234 near p<0.05":
            assert hits == []
        else:
            assert hits == [], (text, hits)


def test_isbn_claims_only_when_valid(spark):
    df = spark.createDataFrame([("9780135957059 and 9780135957058",)], "text string").withColumn(
        "country", F.lit(None).cast("string"))
    hits = resolve.with_matches(df).first()["m"]
    assert [m["text"] for m in hits] == ["9780135957058"]


def noisy_texts(n=150, seed=5):
    rnd = random.Random(seed)
    parts = ["4242424242424242", "5555-5555-5555-4444", "+91 94909 73391", "a@b.co", "12345", "2024", "SSN 123-45-6789",
             "GB29 NWBK 6016 1331 9268 19", "price", "of", "order", "x", "é", "\U0001F600", "key: abc123def456ghi",
             "00:1A:2B:3C:4D:5E", "user1234567890@mail.org", "9780135957059", "patient 943 476 5919", "$1,200.50", "\n"]
    return [" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def noisy(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(noisy_texts())], "id int, text string") \
        .withColumn("country", F.lit(None).cast("string")).cache()
    df.count()
    return df


def test_matches_sorted_and_disjoint(noisy):
    for r in resolve.with_matches(noisy).collect():
        ends = 0
        for m in r["m"]:
            assert m["start"] >= ends and m["end"] > m["start"]
            ends = m["end"]


def test_islands_equal_one_flat_fold(noisy):
    """Settling by islands gives what one pass over all candidates gives."""
    generic, rows = len(detect.catalogue()) - 1, detect.catalogue()
    both = noisy.select("id", detect.candidates(F.col("text")).alias("c"), resolve.explain("text", "country").alias("x"))
    for r in both.collect():
        claims, out = [], []
        for c in sorted(r["c"], key=lambda c: (c["rank"], c["start"])):
            hit = c["rank"] > 0 and any(a < c["end"] and c["start"] < b for a, b in claims)
            if hit:
                outcome = "overlapped"
            elif rows[c["rank"]].action == "claim":
                outcome = "claimed"
            else:
                outcome = "suppressed" if c["reason"] else "emitted"
            if not hit and 0 < c["rank"] < generic:
                claims.append((c["start"], c["end"]))
            out.append([c["start"], -c["end"], c["rank"], outcome])
        reach = -1
        for row in sorted(out):
            if row[3] == "emitted":
                if row[0] >= reach:
                    reach = -row[1]
                else:
                    row[3] = "merged"
        got = sorted([x["start"], -x["end"], x["rank"], x["outcome"]] for x in r["x"])
        assert got == sorted(out)


def test_unmask_restores_text(noisy):
    done = resolve.with_matches(noisy).select("text", mask.unmask(mask.annotate(F.col("text"), F.col("m"))).alias("u"))
    assert done.where("text <> u").count() == 0


def test_masks_keep_length_and_hide(noisy):
    done = resolve.with_matches(noisy).select("text", "m", mask.mask_starred(F.col("text"), F.col("m")).alias("s"))
    for r in done.collect():
        assert len(r["s"]) == len(r["text"])
        for m in r["m"]:
            assert set(r["s"][m["start"]:m["end"]]) == {"*"}


def test_long_text_equals_its_short_copies(spark):
    """Positions far into a text of many blocks are exact."""
    unit = "Charge to 4242424242424242 today, call (555) 123-4567 or write to a@b.co é\U0001F600. " + "word " * 60
    df = spark.createDataFrame([(unit * 300,)], "text string").withColumn("country", F.lit(None).cast("string"))
    hits = resolve.with_matches(df).first()["m"]
    assert len(hits) == 900
    for k, m in enumerate(hits):
        assert m["start"] == (k // 3) * len(unit) + unit.index(m["text"])


def test_mark_character_in_text(spark):
    df = spark.createDataFrame([("ab 1234567  7654321",)], "text string").withColumn(
        "country", F.lit(None).cast("string"))
    assert [m["start"] for m in resolve.with_matches(df).first()["m"]] == [4, 14]


def test_aggressive_profile_keeps_more(noisy):
    precise = noisy.select(F.size(resolve.scan("text", "country")).alias("n")).agg(F.sum("n")).first()[0]
    loose = noisy.select(F.size(resolve.scan("text", "country", profile="aggressive")).alias("n")).agg(F.sum("n")).first()[0]
    assert loose > precise


def test_type_flags(noisy):
    kinds = noisy.select(F.explode(resolve.scan("text", "country", True, False)).alias("m")).select("m.type").distinct().collect()
    assert [k["type"] for k in kinds] == ["email"]
    assert noisy.select(F.explode(resolve.scan("text", "country", False, False))).count() == 0


def test_register_detector(spark):
    detect.register_detector(V.Detector("staff_no", r"\bEMP-\d{5}\b", 1, contains=("EMP-",), dispositive=True))
    try:
        df = spark.createDataFrame([("badge EMP-12345 here",)], "text string").withColumn(
            "country", F.lit(None).cast("string"))
        assert [m["detector"] for m in resolve.with_matches(df).first()["m"]] == ["staff_no"]
        with pytest.raises(ValueError):
            detect.register_detector(V.Detector("staff_no", "x", 1))
    finally:
        detect.unregister_detector("staff_no")
