"""What keeps a scan of many short texts cheap, and that it changes no result."""

import re

from pyspark.sql import functions as F

from maskwright import values as V
from maskwright.functions import rx
from maskwright.functions.arrays import BLOCK, scan_fold
from maskwright.functions.matching import hits
from maskwright.operators import detect, resolve, suppress
from maskwright.sources import probes

RULES = (suppress.is_ordinal_label, suppress.is_date_like, suppress.is_order_ref, suppress.is_public_price, suppress.is_count_noise)


def test_a_file_of_one_split_is_scanned_in_many_parts(spark, sf):
    assert spark.read.parquet(f"{sf}/orders.parquet").rdd.getNumPartitions() == 1
    assert probes.probes(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_pass_for_words_misses_none_of_a_rule(spark):
    words = {w for p in (V.ORDINAL_PRECURSOR, V.DATE_KEYWORD, V.ORDER_REF, V.PUBLIC_PRICE, V.COUNT_NOISE)
             for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"\\.", " ", p))} | {"\u017ftep", "\u212aapitel", "plain", "mi fin"}
    rows = [(f"{left}{w} 12{right}",) for w in sorted(words) for left, right in (("", ""), ("see ", " so"), ("x", "")) for w in (w, w.upper())]
    hit, near = F.lit("12"), F.col("near")
    here = lambda worded: suppress.Around(hit, near, F.instr(near, "12") - 1, worded)
    df = spark.createDataFrame(rows, "near string").select("near", near.rlike(suppress.WORDED).alias("worded"))
    odd = df.where(F.array(*[rule(here(None)) for rule in RULES]) != F.array(*[rule(here(F.col("worded"))) for rule in RULES]))
    assert odd.collect() == [] and 0 < df.where("not worded").count() < df.where("worded").count()


def test_presence_is_found_as_by_the_plain_pattern(spark):
    texts = ["ITEM", "x Stars", "star", "\u661f", "no", "5/mo", "\u00c9toiles", "\u00e9valuation", "", "1 of 2", "me gusta"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (V.PUBLIC_PRICE, V.COUNT_NOISE):
        assert df.where(F.col("t").rlike(rx.finds(p)) != F.col("t").rlike(rx.java(p, True))).collect() == []


def test_folding_a_few_items_at_once_changes_nothing(spark):
    df = spark.createDataFrame([(list(range(1, n + 1)),) for n in (0, 1, 2, BLOCK, BLOCK + 1, 3 * BLOCK)], "xs array<int>")
    sums = [scan_fold(F.col("xs"), F.lit(0), lambda s, x: s + x, lambda s, x: s, "int", brief=b) for b in (False, True)]
    assert df.where(sums[0] != sums[1]).collect() == [] and df.select(F.size(sums[1])).collect()[3][0] == BLOCK


def test_sorted_keeps_equal_ones_as_they_came(spark):
    df = spark.createDataFrame([([(2, "b"), (1, "z"), (2, "a"), (1, "y")],)], "xs array<struct<k:int,v:string>>")
    got = df.select(resolve._sorted(F.col("xs"), lambda c: c["k"])["v"]).first()[0]
    assert got == ["z", "y", "b", "a"]


def test_gates_by_outline_are_those_by_pattern(spark):
    cat = detect.catalogue()
    assert sum(bool(d.gate and detect.outlines(d.gate)) for d in cat) > 15 and sum(bool(d.keyword and detect.word_heads(d.keyword)) for d in cat) > 12
    assert detect.outlines(r"\d{2} ?\d-|[A-Z]\.") == ("00 0-", "000-", "A.") and detect.outlines(r"[XY]\d") == () == detect.outlines(r"\d+")
    assert detect.word_heads(r"\b(?:po\.?\s+box|d\.n\.)\b") == ("po", "d.n.") and detect.word_heads(r"\b(?:a)\b|(?:b)\b") == ()
    texts = ["", "12 345", "12345", "AB12", "aB12", "1.2", "123-45-6789", "00000-123", "SG1", "\u0661\u0662\u0663\u0664", "PO BOX 1234", "Po.box",
             "POSTBUS 1", "Connected 1.2", "d.N.i. 12345678Z", "\u212a 1234", "po\u017ftal 123-4567", "\U0001f600 ZIP 12345-1234"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    screen = detect.Screen(F.col("t"))
    gates = [(screen.holds(d.gate), F.col("t").rlike(rx.java(d.gate))) for d in cat if d.gate]
    words = [(screen.near(d.keyword), F.col("t").rlike(rx.java(rx.strip_boundaries(d.keyword), True))) for d in cat if d.keyword]
    assert df.where(F.array(*[a for a, _ in gates + words]) != F.array(*[b for _, b in gates + words])).collect() == []


def test_every_probe_match_holds_its_outline(spark, sf):
    texts = probes.probes(spark, sf).select("text").unionByName(probes.probes(spark, sf).select(F.upper("text").alias("text")))
    screen = detect.Screen(F.col("text"))
    odd = [F.count_if(F.col("text").rlike(detect.compiled(d)) & ~detect.contains_any(screen.outline, d.outline)) for d in detect.catalogue() if d.outline]
    assert len(odd) > 12 and set(texts.agg(*odd).first()) == {0}


def test_a_single_match_is_placed_where_it_is_and_not_where_its_text_is(spark):
    rows = [("x1234 1234",), ("\U0001f600 12 1234",), ("1234 x1234",), ("12345 1234 1234",), ("11111",), ("none",)]
    got = [[(h["start"], h["end"], h["text"]) for h in r[0]] for r in spark.createDataFrame(rows, "t string").select(
        hits(F.col("t"), r"(?<![0-9x])[0-9]{4}(?![0-9])")).collect()]
    assert got == [[(6, 10, "1234")], [(5, 9, "1234")], [(0, 4, "1234")], [(6, 10, "1234"), (11, 15, "1234")], [], []]
