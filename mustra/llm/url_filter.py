"""URL filters: rules first, link-graph propagation for what no rule decides.

A rule is a host and the start of a path; it fits that host and all its subdomains, and the longest that fits wins.
Pages that a rule allows make their host a trusted seed, pages that a rule blocks a blocked one, each page with mass
1. Trust is the personalised PageRank from the trusted seeds along host edges, which are the links of pages weighed by
their number; a relative link leads to the page's own host, so a host keeps the part of its score that its own links hold. Distrust
is the same from the blocked seeds along reversed edges, so it reaches those who link to blocked hosts. A page that no
rule decides is blocked if distrust makes more than ``threshold`` of what its host has of both, else allowed. So where all
links stay within their hosts, a host's own ruled pages decide on its others: by more blocked than allowed ones.

Scale. Links are aggregated per pair of hosts before the shuffle, scores per host after each step; nothing of the graph
comes to the driver. A step's rows are put into as many partitions as the edges need (``PART_EDGES``), so a small graph isn't
shuffled at all. Every ``CUT_STEPS`` steps the scores are written to the shared folder, which cuts the lineage.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; a null html
has no links; an empty table gives no rows; repeated rows give a row each and count each as a page; other columns
aren't read.
"""

from __future__ import annotations

import re
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mustra.llm.common import stage

DAMPING = 0.85
STEPS = 20
CUT_STEPS = 5
PART_EDGES = 200_000
THRESHOLD = 0.5
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""
_ABROAD = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)"
_SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, written: str) -> Rule:
    """``org/`` is every path of org and its subdomains."""
    host, slash, path = re.match(r"([^/]*)(/?)(.*)", written, re.DOTALL).groups()
    return Rule(host, slash + path, verdict)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ``://``, else an empty string."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, of equally long ones the earlier; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, links: how many links lead from pages of one host to another or the same host; other schemes than those with ``//`` lead to none."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), 1)).alias("link"))
    dst = F.when(F.col("link").rlike(_ABROAD), lower_ascii(F.regexp_extract("link", _ABROAD, 1))).when(F.col("link").rlike(_SCHEME), "").otherwise(F.col("src"))
    links = links.select("src", dst.alias("dst")).filter("src <> '' AND dst <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """host, trust, distrust from ``edges`` (src, dst, links) and ``seeds`` (host, trusted, blocked)."""
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links")
    both = forward.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links"))
    out = both.groupBy("kind", "host").agg(F.sum("links").alias("all"))
    shares = stage(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all")).alias("part")))
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trusted").cast("double"), F.lit("distrust"), F.col("blocked").cast("double"))).alias("kind", "mass")).filter("mass > 0")
    start = stage(start.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score")))
    parts = -(-(shares.count() + start.count()) // PART_EDGES) or 1
    scores = start
    for step in range(1, steps + 1):
        moved = scores.join(shares, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("part") * damping).alias("score"))
        scores = moved.unionByName(start).coalesce(parts).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step % CUT_STEPS == 0:
            scores = stage(scores)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = DAMPING, steps: int = STEPS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, trust, distrust."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("found", apply_rules(F.col("host"), F.col("path"), rules))
    seeds = rows.filter("found IS NOT NULL").groupBy("host").agg(F.count_if(F.col("found.verdict") == "allow").alias("trusted"), F.count_if(F.col("found.verdict") == "block").alias("blocked"))
    scores = stage(propagate(host_edges(pages, url_col, html_col), seeds, damping, steps))
    doubtful = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    verdict = F.coalesce(F.col("found.verdict"), F.when(doubtful, "block").otherwise("allow"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return rows.join(scores, "host", "left").select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), zero("trust"), zero("distrust"))
