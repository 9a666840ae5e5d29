"""Queries over text units: pre-screens, detectors, validators, rules, findings, masks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sql_functions
from .. import values as V
from ..functions import validators as C
from ..functions.arrays import with_once
from ..functions.matching import chunked, hits
from ..functions.rx import java
from ..operators import detect, mask, resolve, sketches, suppress
from ..sources import tables
from ..sources.probes import from_orders, probes
from .registry import query

c = F.col


def units(spark, sf_dir):
    """Documents and probe texts as one relation of text units."""
    return tables.spread(tables.documents(spark, sf_dir).withColumn("src", F.lit("doc")).unionByName(
        probes(spark, sf_dir).withColumn("src", F.lit("probe"))))


@query("scan_text")
def scan_text(spark, sf_dir):
    docs = tables.documents(spark, sf_dir).select(F.lit("documents").alias("src"), "id", "text")
    talk = tables.conversations(spark, sf_dir).select(F.lit("conversations").alias("src"), "id", "text")
    return docs.unionByName(talk).select("src", "id", F.length("text").alias("n_chars"))


@query("prescreens")
def prescreens(spark, sf_dir):
    """Counts of the cheap text filters, in one pass."""
    t = c("text")
    return units(spark, sf_dir).groupBy("src").agg(
        F.count("*").alias("units"),
        F.count_if(F.length(t) >= 4).alias("min_len"),
        F.count_if(detect.has_digit(t)).alias("has_digit"),
        F.count_if(detect.has_digit_or_long_alnum(t)).alias("has_digit_or_long_alnum"),
        F.count_if(t.contains("@")).alias("has_at"),
        F.count_if(resolve.scannable(t, True, True)).alias("scan_both"),
        F.count_if(resolve.scannable(t, False, True)).alias("scan_numeric"),
        F.count_if(resolve.scannable(t, False, False)).alias("scan_none"))


@query("detector_prescreen")
def detector_prescreen(spark, sf_dir):
    """How many units pass the whole-text gate of each detector."""
    rows = [d for d in detect.catalogue() if d.stage in (1, 2)]

    def gate(d):
        g = F.lit(False)
        for word in d.contains:
            g = g | c("text").contains(word)
        return c("text").rlike(java(d.gate)) if d.gate else g
    passed = units(spark, sf_dir).where(detect.has_digit(c("text"))).agg(
        *[F.count_if(gate(d)).alias(d.id) for d in rows])
    return passed.unpivot([], [d.id for d in rows], "detector", "units")


@query("min_len")
def min_len(spark, sf_dir):
    return tables.conversations(spark, sf_dir).where(F.length("text") >= 4).select("id")


@query("has_digit")
def has_digit(spark, sf_dir):
    return units(spark, sf_dir).where(detect.has_digit(c("text"))).select("src", "id")


@query("has_digit_or_long_alnum")
def has_digit_or_long_alnum(spark, sf_dir):
    return units(spark, sf_dir).where(detect.has_digit_or_long_alnum(c("text"))).select("src", "id")


@query("has_at")
def has_at(spark, sf_dir):
    return units(spark, sf_dir).where(c("text").contains("@")).select("src", "id")


@query("detectors")
def detectors(spark, sf_dir):
    """The catalogue next to the number of units whose country each detector trusts."""
    known = sorted({code for d in detect.catalogue() for code in d.countries})
    seen = units(spark, sf_dir).where(c("country").isin(*known)).groupBy("country").count()
    cat = detect.detectors_table(spark).withColumn("country", F.explode_outer("countries"))
    joined = cat.join(F.broadcast(seen), "country", "left")
    return joined.groupBy("rank", "detector", "stage", "action", "validator").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("trusted_units"))


def _detector_query(detector: str):
    @query(f"detect_{detector}")
    def run(spark, sf_dir):
        """Accepted matches of one detector, before overlaps are settled."""
        found = detect.candidates(c("text"), c("country"), only=(detector,))
        return units(spark, sf_dir).select("src", "id", F.inline(found)).select(
            "src", "id", c("start").alias("start_pos"), c("end").alias("end_pos"), c("text").alias("hit"))
    return run


for _d in detect.catalogue():
    if _d.id != "numeric_generic":
        _detector_query(_d.id)


@query("numeric_generic")
def numeric_generic(spark, sf_dir):
    """Generic numbers with the alternative that fits and the rule that would drop them."""
    found = detect.candidates(c("text"), c("country"), only=("numeric_generic",))
    alternative = F.lit("other")
    for name, p in reversed(V.NUMERIC_ALTERNATIVES):
        whole = java(p)
        alternative = F.when(c("hit").rlike(rf"\A(?:{whole})\z"), name).otherwise(alternative)
    return units(spark, sf_dir).select("src", "id", F.inline(found)).select(
        "src", "id", c("start").alias("start_pos"), c("text").alias("hit"), "reason") \
        .withColumn("alternative", alternative)


@query("secret_value_ok")
def secret_value_ok(spark, sf_dir):
    """Values after a keyword that the value filter keeps or drops."""
    pattern = detect.compiled(next(d for d in detect.catalogue() if d.id == "keyword_value"))
    return units(spark, sf_dir).select(
        "src", "id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("value")) \
        .select("src", "id", "value", C.secret_value_ok(c("value")).alias("ok"))


# ------------------------------------------------------------- validators

def digit_runs(spark, sf_dir):
    """Numbers cut out of the probe and document texts."""
    return units(spark, sf_dir).select("src", "id", F.explode(
        F.regexp_extract_all("text", F.lit(r"[0-9]+[Xx]?"), F.lit(0))).alias("s"))


def _validator_query(name: str, check):
    @query(name)
    def run(spark, sf_dir):
        return digit_runs(spark, sf_dir).groupBy(F.length("s").alias("len")).agg(
            F.count("*").alias("n"), F.count_if(check(c("s"))).alias("valid"))
    return run


_validator_query("luhn_ok", C.luhn_ok)
_validator_query("verhoeff_ok", C.verhoeff_ok)
_validator_query("iso7064_11_2_ok", C.iso7064_11_2_ok)
_validator_query("isbn13_ok", C.isbn13_ok)
_validator_query("isbn10_ok", C.isbn10_ok)


@query("mod97_ok")
def mod97_ok(spark, sf_dir):
    """IBAN-shaped words: length by country and the mod-97 check."""
    words = units(spark, sf_dir).select("src", "id", F.explode(F.regexp_extract_all(
        F.regexp_replace("text", "[ -]", ""), F.lit(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{6,30}"), F.lit(0))).alias("s"))
    return words.select(
        "src", "id", "s", C.mod97_ok(c("s")).alias("mod97"),
        C.iban_country_len(F.substring("s", 1, 2)).alias("expected_len"))


@query("mod11_weighted")
def mod11_weighted(spark, sf_dir):
    """Residues of the numbers; -1 for all that have not as many digits as there are weights."""
    return digit_runs(spark, sf_dir).groupBy(C.mod11_weighted(c("s"), V.NHS_WEIGHTS).alias("residue")).agg(
        F.count("*").alias("n"))


@query("card_network")
def card_network(spark, sf_dir):
    return digit_runs(spark, sf_dir).where(F.length("s").between(12, 20)).groupBy(
        C.card_network(c("s")).alias("network")).agg(
        F.count("*").alias("n"), F.count_if(C.luhn_ok(c("s"))).alias("luhn"))


@query("iban_country_len")
def iban_country_len(spark, sf_dir):
    codes = units(spark, sf_dir).select(F.explode(F.regexp_extract_all(
        "text", F.lit(r"([A-Z]{2})[0-9]{2}"), F.lit(1))).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n"),
                                     F.max(C.iban_country_len(c("code"))).alias("iban_len"))


@query("ipv4_public")
def ipv4_public(spark, sf_dir):
    quads = units(spark, sf_dir).select("src", "id", F.explode(F.regexp_extract_all(
        "text", F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.lit(0))).alias("ip"))
    return quads.select("src", "id", "ip", C.ipv4_public(c("ip")).alias("public"))


@query("strip_separators")
def strip_separators(spark, sf_dir):
    groups = units(spark, sf_dir).select("src", "id", F.explode(F.regexp_extract_all(
        "text", F.lit(r"[0-9][0-9 -]+[0-9]"), F.lit(0))).alias("raw"))
    return groups.select("src", "id", "raw", C.strip_separators(c("raw")).alias("digits"))


# ---------------------------------------------------------- context gates


def gated(spark, sf_dir):
    """Every context-gated shape, whatever else its text holds, so that each gate can be asked on its own."""
    rows = [(i, d) for i, d in enumerate(detect.catalogue()) if not d.dispositive]
    ids = tuple(d.id for _, d in rows)
    raw = detect.extract(c("text"), F.lit(None).cast("string"), False, True, only=ids, context=False)
    found = units(spark, sf_dir).withColumn("h", F.explode(raw)).select(
        "src", "id", "country", "text", c("h.rank").alias("rank"), c("h.start").alias("s"),
        c("h.end").alias("e"), c("h.text").alias("hit"))
    return found, rows


@query("keyword_window")
def keyword_window(spark, sf_dir):
    """Is a keyword near the match?"""
    found, rows = gated(spark, sf_dir)
    near = None
    for i, d in rows:
        lo = F.greatest(c("s") - d.window, F.lit(0))
        hit = F.substring("text", lo + 1, c("e") + d.window - lo).rlike(java(d.keyword, True))
        near = F.when(c("rank") == i, hit) if near is None else near.when(c("rank") == i, hit)
    return found.select("src", "id", detect.detector_name(c("rank")).alias("detector"),
                        c("s").alias("start_pos"), "hit", near.alias("keyword"))


@query("country_gate")
def country_gate(spark, sf_dir):
    found, rows = gated(spark, sf_dir)
    ok = None
    for i, d in rows:
        hit = detect.in_countries(c("country"), d.countries)
        ok = F.when(c("rank") == i, hit) if ok is None else ok.when(c("rank") == i, hit)
    return found.where(ok).groupBy(
        detect.detector_name(c("rank")).alias("detector"), "country").agg(F.count("*").alias("n"))


@query("gate_order")
def gate_order(spark, sf_dir):
    """The gate that decided on each accepted shape."""
    rows = [(i, d) for i, d in enumerate(detect.catalogue()) if d.stage in (1, 2)]
    found = detect.candidates(c("text"), c("country"), email=False)
    cands = units(spark, sf_dir).select("src", "id", "country", F.inline(found)).where(
        c("rank").isin(*[i for i, _ in rows]))
    decided = None
    for i, d in rows:
        by = F.lit("shape" if not d.validator else "checksum") if d.dispositive else \
            F.when(detect.in_countries(c("country"), d.countries), "country").otherwise("keyword")
        decided = F.when(c("rank") == i, by) if decided is None else decided.when(c("rank") == i, by)
    return cands.groupBy(detect.detector_name(c("rank")).alias("detector"), decided.alias("decided_by")) \
        .agg(F.count("*").alias("n"))


# --------------------------------------------------- false-positive rules


@query("suppressors")
def suppressors(spark, sf_dir):
    """Every rule on its own for every generic number, not only the first that fires."""
    pattern = detect.compiled(next(d for d in detect.catalogue() if d.id == "numeric_generic"))
    near = c("near")
    rows = units(spark, sf_dir).where(detect.has_digit(c("text"))).select(
        "src", "id", "text", F.inline(hits(c("text"), pattern)).alias("s", "e", "hit"))
    lo = F.greatest(c("s") - suppress.MARGIN, F.lit(0))
    sliced = rows.withColumn("near", F.substring("text", lo + 1, F.greatest(
        c("s") + suppress.MARGIN, c("e") + suppress.TAIL) - lo))
    around = suppress.Around(c("hit"), near, F.least(c("s"), F.lit(suppress.MARGIN)))
    return sliced.select("src", "id", c("s").alias("start_pos"), "hit", *[
        v.alias(k) for k, v in suppress.checks(around).items()])


def _rule_query(rule: str):
    @query(rule)
    def run(spark, sf_dir):
        """Generic numbers one rule would drop, whatever the other rules say."""
        return suppressors(spark, sf_dir).where(c(rule)).select("src", "id", "start_pos", "hit")
    return run


def _alternative_query(name: str):
    @query(name)
    def run(spark, sf_dir):
        """Generic numbers of one shape."""
        return numeric_generic(spark, sf_dir).where(c("alternative") == name).select(
            "src", "id", "start_pos", "hit", "reason")
    return run


for _rule in suppress.PROFILES["precise"]:
    _rule_query(_rule.__name__)
for _name, _ in V.NUMERIC_ALTERNATIVES:
    _alternative_query(_name)


@query("suppress_reason")
def suppress_reason(spark, sf_dir):
    found = detect.candidates(c("text"), c("country"), email=False, only=("numeric_generic",))
    return units(spark, sf_dir).select("src", F.inline(found)).groupBy("src", "reason").agg(
        F.count("*").alias("n"))


@query("scan_aggressive")
def scan_aggressive(spark, sf_dir):
    """Findings under the profile that keeps only the version rule."""
    return _findings(tables.spread(tables.documents(spark, sf_dir)), profile="aggressive")


# -------------------------------------------------- resolution and reports


def _findings(df, *keys, **kw):
    return df.select(*(keys or ("id",)), F.inline(resolve.scan("text", "country", **kw))).select(
        *(keys or ("id",)), c("start").alias("start_pos"), c("end").alias("end_pos"), "type",
        "detector", c("text").alias("hit"))


@query("scan")
def scan(spark, sf_dir):
    """Findings of every document."""
    return _findings(tables.spread(tables.documents(spark, sf_dir)))


@query("pii_scan")
def pii_scan(spark, sf_dir):
    """Findings of every document, by the SQL function."""
    sql_functions.register(spark)
    return spark.sql("""
        SELECT id, f.* FROM (SELECT id, pii_scan(text, country) AS m FROM {docs})
        LATERAL VIEW inline(m) f AS start_pos, end_pos, type, detector, hit""", docs=tables.spread(tables.documents(spark, sf_dir)))


@query("pii_mask")
def pii_mask(spark, sf_dir):
    """Every document with its findings starred, by the SQL function."""
    sql_functions.register(spark)
    return spark.sql("SELECT id, md5(pii_mask(text, 'starred', country)) AS masked_md5 FROM {docs}",
                     docs=tables.spread(tables.documents(spark, sf_dir)))


@query("scan_conversations")
def scan_conversations(spark, sf_dir):
    return _findings(tables.spread(tables.conversations(spark, sf_dir)))


@query("scan_probes")
def scan_probes(spark, sf_dir):
    """Findings of the probe texts, which exercise every detector and gate."""
    return _findings(tables.spread(probes(spark, sf_dir)))


@query("priority_claim")
def priority_claim(spark, sf_dir):
    """Outcome of every candidate: who claimed, who was overlapped, who was dropped and why."""
    return tables.spread(probes(spark, sf_dir)).select("id", F.inline(resolve.explain("text", "country"))) \
        .select("id", "rank", c("start").alias("start_pos"), c("end").alias("end_pos"),
                c("text").alias("hit"), "reason", "outcome")


@query("final_merge")
def final_merge(spark, sf_dir):
    """Findings per unit after the left-to-right merge, with the covered length."""
    return resolve.with_matches(units(spark, sf_dir)).where(F.size("m") > 0).select(
        "src", "id", F.size("m").alias("n"),
        F.aggregate("m", F.lit(0), lambda a, x: a + x["end"] - x["start"]).alias("covered"),
        F.element_at("m", 1)["start"].alias("first_start"),
        F.element_at("m", -1)["end"].alias("last_end"))


@query("type_gate")
def type_gate(spark, sf_dir):
    """Only the families a unit enables are scanned; the flags are columns."""
    flagged = units(spark, sf_dir).withColumn("email_on", c("id") % 2 == 0) \
        .withColumn("numeric_on", c("id") % 3 == 0)
    found = resolve.scan("text", "country", "email_on", "numeric_on")
    return flagged.select("src", "email_on", "numeric_on", F.inline(found)) \
        .groupBy("src", "email_on", "numeric_on", "type").agg(F.count("*").alias("n"))


@query("match_count")
def match_count(spark, sf_dir):
    return tables.spread(tables.documents(spark, sf_dir)).select(
        "id", F.size(resolve.scan("text", "country")).alias("n"))


@query("scan_stats")
def scan_stats(spark, sf_dir):
    """The five counters of a scan, per source."""
    generic = len(detect.catalogue()) - 1
    done = with_once(
        units(spark, sf_dir).where(resolve.scannable(c("text"), True, True)),
        x=resolve.explain("text", "country")).withColumn("digit", detect.has_digit(c("text")))

    def count(cond):
        return F.size(F.filter("x", cond))
    return done.groupBy("src").agg(
        F.count("*").alias("node_count"),
        F.count_if("digit").alias("digit_node_count"),
        F.sum(count(lambda x: x["rank"] == generic)).alias("stage3_candidates"),
        F.sum(count(lambda x: (x["rank"] == generic) & x["outcome"].isin("overlapped", "suppressed")))
        .alias("stage4_suppressed"),
        F.sum(count(lambda x: x["outcome"].isin("emitted", "merged"))).alias("total_emit"))


@query("findings_rollup")
def findings_rollup(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents").select(
        c("doc_id").alias("id"), "text", "lang", "source", F.lit(None).cast("string").alias("country"))
    return _findings(tables.spread(docs), "source", "lang").rollup("source", "lang", "detector").agg(
        F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query("findings_cube")
def findings_cube(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents").select(
        c("doc_id").alias("id"), "text", "lang", F.lit(None).cast("string").alias("country"))
    return _findings(tables.spread(docs), "lang").cube("lang", "type").agg(
        F.count("*").alias("n"), F.sum(c("end_pos") - c("start_pos")).alias("chars"))


@query("distinct_values")
def distinct_values(spark, sf_dir):
    """Distinct sensitive values per detector; values are hashed before they are shuffled."""
    found = _findings(units(spark, sf_dir), "src", "id")
    seen = found.select("detector", F.sha2("hit", 256).alias("value")).groupBy("detector", "value") \
        .agg(F.count("*").alias("n"))
    return seen.groupBy("detector").agg(F.sum("n").alias("findings"), F.count("*").alias("distinct_values"))


@query("distinct_values_sketch")
def distinct_values_sketch(spark, sf_dir):
    """Different values per detector from sketches of every month, merged, and whether that is near the exact count."""
    orders = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    texts = from_orders(tables.spread(tables.dealt(orders)), month=F.date_trunc("month", c("o_orderdate").cast("timestamp")))
    found = tables.materialise(_findings(texts, "month").select("month", "detector", "hit"), "months")
    kept = tables.materialise(sketches.value_sketches(found, ["month", "detector"]), "sketches")
    about = sketches.distinct_over(kept, ["detector"]).withColumnRenamed("distinct_values", "about")
    exact = found.select("detector", F.sha2("hit", 256).alias("value")).distinct().groupBy("detector").agg(
        F.count("*").alias("distinct_values"))
    near = F.abs(c("about") - c("distinct_values")) <= F.lit(sketches.bound()) * c("distinct_values") + 1
    return about.join(exact, "detector").select("detector", "findings", "distinct_values", near.alias("near"))


@query("findings_by_quality")
def findings_by_quality(spark, sf_dir):
    """Findings of labelled documents by label; only keys and counts meet in the join."""
    labels = tables.read(spark, sf_dir, "labels")
    counts = match_count(spark, sf_dir)
    return counts.join(labels, counts["id"] == labels["doc_id"]).groupBy("quality", "toxic").agg(
        F.count("*").alias("docs"), F.sum("n").alias("findings"))


# ------------------------------------------------------------------- masks


def _masked(spark, sf_dir, render):
    done = resolve.with_matches(units(spark, sf_dir)).where(F.size("m") > 0)
    return with_once(done, masked=render(c("text"), c("m"))).select(
        "src", "id", F.md5("masked").alias("masked_md5"), F.length("masked").alias("n_chars"))


@query("mask_starred")
def mask_starred(spark, sf_dir):
    return _masked(spark, sf_dir, mask.mask_starred)


@query("mask_redacted")
def mask_redacted(spark, sf_dir):
    return _masked(spark, sf_dir, mask.mask_redacted)


@query("mask_censored")
def mask_censored(spark, sf_dir):
    return _masked(spark, sf_dir, mask.mask_censored)


@query("annotate_spans")
def annotate_spans(spark, sf_dir):
    return _masked(spark, sf_dir, mask.annotate)


@query("unmask")
def unmask(spark, sf_dir):
    """Annotating and unmasking gives the text back."""
    done = resolve.with_matches(units(spark, sf_dir))
    return done.select("src", "id", F.md5(mask.unmask(mask.annotate(c("text"), c("m")))).alias("text_md5"))


@query("skip_already_masked")
def skip_already_masked(spark, sf_dir):
    """What a second scan may look at: the text outside the spans, part by part."""
    done = resolve.with_matches(units(spark, sf_dir)).where(F.size("m") > 0)
    return done.select("src", "id", F.posexplode(mask.unmasked_parts(mask.annotate(c("text"), c("m"))))
                       .alias("part", "outside")).select(
        "src", "id", "part", F.length("outside").alias("n_chars"), F.md5("outside").alias("md5"))


def _talk(spark, sf_dir):
    turns = tables.read(spark, sf_dir, "conversations").select(
        c("conv_id").alias("page_id"), c("turn").alias("node_id"), "text")
    keys = turns.select("page_id").distinct()
    ranges = keys.select("page_id", F.explode(F.expr(
        "array(struct('a' AS range_id, 5 AS start, 40 AS end), "
        "struct('b' AS range_id, CAST(100 + page_id % 50 AS INT) AS start, CAST(700 + page_id % 90 AS INT) AS end), "
        "struct('c' AS range_id, 60 AS start, 60 AS end))")).alias("r")).select("page_id", "r.*")
    return turns, ranges


@query("mask_range")
def mask_range(spark, sf_dir):
    """Two ranges of every conversation, clipped to each turn they touch."""
    turns, ranges = _talk(spark, sf_dir)
    return mask.mask_range(turns, ranges).select(
        "page_id", "node_id", "range_id", "lo", "hi", F.md5("masked").alias("masked_md5"))


@query("remove_mask_range")
def remove_mask_range(spark, sf_dir):
    turns, ranges = _talk(spark, sf_dir)
    gone = ranges.where((c("range_id") == "a") | (c("page_id") % 4 == 0)).select("page_id", "range_id")
    return mask.mask_range(turns, mask.remove_ranges(ranges, gone)).select(
        "page_id", "node_id", "range_id", "lo", "hi")


def _written(spark, name: str, write):
    """Write below the shared folder, read back."""
    path = tables.scratch(spark, f"{name}-{uuid.uuid4().hex}")
    write(path)
    return spark.read.parquet(path)


@query("findings_sink")
def findings_sink(spark, sf_dir):
    """Findings written by detector and read back."""
    found = _findings(tables.spread(tables.documents(spark, sf_dir)))
    back = _written(spark, "findings", lambda path: tables.write_findings(found, path))
    return back.select("id", "start_pos", "end_pos", "type", c("detector").cast("string"), "hit")


@query("masked_sink")
def masked_sink(spark, sf_dir):
    """Masked documents written and read back."""
    docs = resolve.with_matches(tables.spread(tables.documents(spark, sf_dir)))
    masked = docs.select("id", mask.mask_starred(c("text"), c("m")).alias("text"))
    back = _written(spark, "masked", lambda path: tables.write_masked(masked, path))
    return back.select("id", F.md5("text").alias("masked_md5"))
