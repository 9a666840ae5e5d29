"""URL filter: literal rules first, then trust and distrust spread over host links.

Trust is a personalised PageRank that restarts at trusted hosts and follows
links; distrust restarts at blocked hosts and follows links backwards, to the
hosts that point at them. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, stored

#: (verdict, host, path): the rule of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: href of an anchor; neither part crosses a tag border, so the scan stays linear.
HREF = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?([^"'\s<>]+)"""
LINK_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\\]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ordered)], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ordered)], F.lit(None).cast("string"))
    return rule, verdict


def host_edges(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): links between different hosts, counted per link."""
    links = pages.where(F.col(host_col) != "").select(
        F.col(host_col).alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(HREF), 1)).alias("href"))
    links = links.select("src", ascii_lower(F.regexp_extract("href", LINK_HOST, 1)).alias("dst"))
    return links.where((F.col("dst") != "") & (F.col("dst") != F.col("src"))).groupBy("src", "dst").agg(
        F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 200,
              tolerance: float = 1e-5) -> DataFrame:
    """(kind, host, score) from seeds (kind, host, mass) over edges (src, dst, n).

    ``kind`` trust follows links, ``kind`` distrust follows them backwards. A
    host passes on ``damping`` of its score in proportion to its links; hosts
    without a link pass on nothing. Stops when the scores move by at most
    ``tolerance`` in all; ``rounds`` only bounds walks that never settle.
    """
    ways = edges.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n"),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))).alias("e"))
    ways = ways.select("e.*")
    total = ways.groupBy("kind", "a").agg(F.sum("n").alias("total"))
    ways = stored(ways.join(total, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("total")).alias("w")), "host-edges")
    start = stored(seeds.select("kind", "host", ((1 - damping) * F.col("mass")).alias("score")), "host-seeds")
    scores = start
    for _ in range(rounds):
        old = scores.select("kind", F.col("host").alias("a"), "score")
        flow = ways.join(old, ["kind", "a"]).select("kind", F.col("b").alias("host"),
                                                    (damping * F.col("w") * F.col("score")).alias("score"))
        new = stored(flow.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score")), "host-scores")
        moved = new.join(scores.withColumnRenamed("score", "was"), ["kind", "host"], "full").agg(
            F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        scores = new
        if (moved or 0.0) <= tolerance:
            break
    return scores


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
               seed_share: float = 0.5, damping: float = 0.85, rounds: int = 200, block_share: float = 0.5,
               block_score: float = 0.01) -> DataFrame:
    """(id, host, path, rule, verdict, by_rule) for every row.

    The longest rule decides where one fits. Elsewhere the host does: hosts
    with at least ``seed_share`` of their pages allowed (blocked) by rules are
    trusted (distrusted) seeds of mass 1; a host is blocked when its distrust
    is at least ``block_score`` and at least ``block_share`` of its trust plus
    distrust. Other hosts, the empty host and hosts without links are allowed.
    Null html has no links. Repeated rows are judged each; an empty table gives
    an empty table.
    """
    host, path = host_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    shares = ruled.where(F.col("host") != "").groupBy("host").agg(
        F.avg(F.coalesce((F.col("ruled") == "allow").cast("double"), F.lit(0.0))).alias("trust"),
        F.avg(F.coalesce((F.col("ruled") == "block").cast("double"), F.lit(0.0))).alias("distrust"))
    seeds = shares.select("host", F.stack(F.lit(2), F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))
                          .alias("kind", "share")).where(F.col("share") >= seed_share)
    seeds = seeds.select("kind", "host", F.lit(1.0).alias("mass"))
    linked = pages.select(host.alias("host"), F.col(html_col).alias("html"))
    scores = propagate(host_edges(linked, "host", "html"), seeds, damping, rounds, block_score / 1000)
    by_host = scores.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("d"),
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("t"))
    bad = by_host.where((F.col("d") >= block_score) & (F.col("d") >= block_share * (F.col("d") + F.col("t"))))
    bad = bad.select(F.col("host").alias("bad_host"))
    return ruled.join(bad, F.col("host") == F.col("bad_host"), "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))
