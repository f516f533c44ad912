"""URL filters: block and allow rules, and for urls that no rule fits, trust and distrust from the link graph of hosts.

Trust is personalised PageRank from the trusted hosts along links; distrust runs from the blocked hosts against
links (who links to blocked hosts is suspect). Both are power iterations over aggregated host edges in Spark: an
edge row a pair of hosts, a rank row a host, checkpointed each round; the links of a hub and the pages of a hot host
are spread over tasks. The mass of hosts without links goes
back to the seeds, as in a walk that starts anew. A host is blocked when its distrust, times `bias`, is above
its trust and above `floor` times the mean rank; each host is judged once and pages take their host's verdict.

Edges are the absolute http links of a page's html to other hosts, weighted by their number. A blocked seed is a
host all of whose pages a rule blocks, a trusted seed one with pages that a rule allows and none that it blocks; a
host blocked in part is neither. Without seeds or links every host is allowed.

A null url, or one without ://, has an empty host and path and gets the verdict of an unlinked host: allow. A
null html has no links. Repeated rows are judged alike, and repeated links add weight. An empty table gives an
empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import HOT, UPPER, cut, spread_join


@dataclass(frozen=True)
class UrlRule:
    """Fits a host with its subdomains, on paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # a longer rule overrules what stands before
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with a `host` -> (src, dst, weight): links between different hosts."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?(https?://[^\s\"'<>]+)"), F.lit(1))
    edges = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("link"))
    edges = edges.select("src", host_of(F.col("link")).alias("dst")).filter("dst <> '' and src <> dst")
    return edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(host, rank): where a walk along the edges is found that starts anew at a seed with probability 1 - damping.

    seeds: distinct hosts. The ranks sum to 1 if there is a seed. Mass at hosts without an edge is dealt to the
    seeds too; that sum is one number a round.
    """
    seed_count = seeds.count()
    if not seed_count:
        return seeds.select("host", F.lit(0.0).alias("rank"))
    start = seeds.select("host", F.lit(1.0 / seed_count).alias("start"))
    n_edges = edges.count()
    if not n_edges:
        return start.select("host", F.col("start").alias("rank"))
    out = cut(edges.groupBy(F.col("src").alias("on")).agg(F.sum("weight").alias("total"), F.count("*").alias("n")))
    part = (F.col("weight") / F.col("total") * damping).alias("part")
    steps = cut(spread_join(edges.select("src", "dst", "weight"), out.select("on", "total"), "src", out, n_edges).select("src", "dst", part))
    # hubs, at most HOT of them, apart: their ranks are broadcast, so that no task gets all links of one
    hubs = cut(out.filter(F.col("n") >= max(n_edges / HOT, 2)).select(F.col("on").alias("hub")))
    of_hubs = cut(steps.join(F.broadcast(hubs), F.col("src") == F.col("hub"), "left_semi"))
    others = cut(steps.join(F.broadcast(hubs), F.col("src") == F.col("hub"), "left_anti"))
    some_hubs, some_others = not hubs.isEmpty(), not others.isEmpty()
    rank = start.select("host", F.col("start").alias("rank"))
    for _ in range(rounds):
        parts = []
        if some_hubs:
            own = F.broadcast(rank.join(F.broadcast(hubs), F.col("host") == F.col("hub"), "left_semi"))
            parts.append(of_hubs.join(own, F.col("host") == F.col("src")))
        if some_others:
            parts.append(others.join(rank, F.col("host") == F.col("src")))
        moved = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        arrived = cut(moved.groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("part")).alias("rank")))
        # what did not move (restarts and hosts without links) is one minus what arrived
        missing = 1.0 - (arrived.agg(F.sum("rank")).first()[0] or 0.0)
        anew = start.select("host", (F.col("start") * missing).alias("rank"))
        rank = arrived.unionByName(anew).groupBy("host").agg(F.sum("rank").alias("rank"))
    return rank


def host_verdicts(hosts: DataFrame, edges: DataFrame, trusted: DataFrame, blocked: DataFrame, bias: float = 1.0, floor: float = 0.01, **walk) -> DataFrame:
    """(host, trust, distrust, verdict) for distinct hosts."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = propagate(edges, trusted, **walk).select(F.col("host").alias("t_host"), F.col("rank").alias("trust"))
    distrust = propagate(back, blocked, **walk).select(F.col("host").alias("d_host"), F.col("rank").alias("distrust"))
    n = max(hosts.count(), 1)
    judged = hosts.join(trust, hosts["host"] == trust["t_host"], "left").join(distrust, hosts["host"] == distrust["d_host"], "left")
    judged = judged.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    bad = (F.col("distrust") * bias > F.col("trust")) & (F.col("distrust") > floor / n)
    return judged.withColumn("verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...], id: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): the longest rule's verdict, else the host's by the link graph."""
    split = pages.select(F.col(id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    hosts = cut(ruled.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"), F.count("*").alias("n")))
    trusted = hosts.filter("good > 0 and bad = 0").select("host")
    blocked = hosts.filter("bad = n").select("host")
    edges = cut(host_edges(split))
    known = host_verdicts(hosts.select("host"), edges, trusted, blocked, **options)
    known = cut(known.select(F.col("host").alias("on"), "trust", "distrust", F.col("verdict").alias("by_graph")))
    total = hosts.agg(F.sum("n")).first()[0] or 0
    joined = spread_join(ruled.filter("host <> ''"), known, "host", hosts.select(F.col("host").alias("on"), "n"), total)
    none = ruled.filter("host = ''").withColumns({"trust": F.lit(0.0), "distrust": F.lit(0.0), "by_graph": F.lit("allow")})
    return joined.unionByName(none).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", "by_graph", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
