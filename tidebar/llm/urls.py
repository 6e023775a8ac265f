"""URL filters: rules first, then trust and distrust spread over the host graph.

A rule (host, path) fits its host and all subdomains where the url's path starts with the
rule's; the longest fitting rule decides. Other pages get their host's verdict: trust flows
along links from hosts whose pages the rules allow (personalised PageRank), distrust flows
against links from hosts whose pages they block, and a host is blocked where its distrust is
at least ``ratio`` times its trust.

The graph is counted by host before anything is joined: a host with a third of all pages is
one row of each table, and its links are one row per linked host. Each round passes on what
came in the round before, until that adds less than ``tolerance`` of its score to every host.
Seeds count pages, so a host's scores don't depend on the rest of the corpus; they are
rounded to nine digits, so that the order of additions cannot turn a verdict.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed; null html has no links; links without a host stay on their page's host;
hosts without evidence are allowed; repeated rows count as often as they occur; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebar.llm.base import lower_ascii
from tidebar.session import staged

# Verdict, host and path of each rule.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
URL = r"(?s)^(?:.*?)://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest ends up outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links between hosts, with their number; repeats are added up before the shuffle."""
    links = pages.select(
        host_of(F.col("url")).alias("source"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), 1)).alias("target"))
    return (links.select("source", lower_ascii(F.col("target")).alias("target"))
            .where("source != '' and source != target").groupBy("source", "target").agg(F.count("*").alias("links")))


def _rounded(score: Column) -> Column:
    """To nine significant digits, whatever its size."""
    return F.format_string("%.8e", score).cast("double")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) spread from seeds (host, trust, distrust).

    Trust goes from a page's host to the hosts it links to, distrust from a host to those
    that link to it; each host shares its score out by the number of links. What a round
    moves is ``damping`` times what the round before moved, or less, so the rounds end.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "links") \
        .unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "links"))
    totals = both.groupBy("kind", "host").agg(F.sum("links").alias("all_links"))
    shares = staged(both.join(totals, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all_links")).alias("share")), "url-shares")
    state = staged(
        seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, score)"))
        .groupBy("kind", "host").agg((F.sum("score") * (1 - damping)).alias("score")).where("score > 0")
        .withColumn("fresh", F.col("score")), "url-seeds")
    # a host's score and what of it came in the last round
    while True:
        moved = state.where("fresh > 0").join(shares, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), F.lit(0.0).alias("score"), (F.col("fresh") * F.col("share") * damping).alias("fresh"))
        state = staged(
            state.withColumn("fresh", F.lit(0.0)).unionByName(moved).groupBy("kind", "host")
            .agg(F.sum("score").alias("score"), F.sum("fresh").alias("fresh"))
            .select("kind", "host", (F.col("score") + F.col("fresh")).alias("score"), "fresh"), "url-scores")
        if state.where(F.col("fresh") > tolerance * F.col("score")).isEmpty():
            break
    return state.groupBy("host").agg(
        _rounded(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0))).alias("trust"),
        _rounded(F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0))).alias("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, ratio: float = 3.0, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and its host's trust and distrust."""
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("fits", rule_column(F.col("host"), F.col("path"), rules))
    counted = ruled.where("host != ''").groupBy("host").agg(
        F.sum(F.when(F.col("fits.verdict") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
        F.sum(F.when(F.col("fits.verdict") == "block", 1.0).otherwise(0.0)).alias("blocked"))
    counted = staged(counted, "url-hosts")
    seeds = counted.select("host", F.col("allowed").alias("trust"), F.col("blocked").alias("distrust"))
    scores = staged(propagate(host_edges(pages), seeds, damping, tolerance), "url-trust")
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= ratio * F.coalesce(F.col("trust"), F.lit(0.0)))
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"),
        F.coalesce(F.col("fits.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "trust", "distrust")
