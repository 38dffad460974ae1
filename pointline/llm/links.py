"""Verdicts on urls: fixed rules first, then trust spread over the link graph, in DataFrame operations only.

Nodes are hosts without user, port and final dot; edges are the links between different hosts in the pages' ``href`` attributes (http, https or
protocol-relative; not within comments), counted once per pair of hosts and weighted evenly over a host's targets. Distrust starts at the hosts that a rule blocks as a whole (path ``/``), trust
at the others of which a rule allows a page; each seed has 1, however many there are. Trust is personalised PageRank from its seeds: a host passes
it on to its targets. Distrust goes the other way: a host takes the mean of its targets' (damped), however many others link to them. So a
verdict depends on the host's surroundings only, not on how many hosts there are. A host is blocked if its distrust is over ``margin`` times its
trust plus ``floor``; a host without trust that links to blocked seeds is, if more than ``floor`` / 0.1275 of its links go there. What a host without links
passes on is lost. Rounds end when what all later ones could add is under ``rest``; every ``cut`` rounds write one table of hosts to the shared folder.

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule, and the method's verdict for the empty
host, which no link reaches: allow. Repeated pages and other columns are passed over or judged alike. Without seeds there is no
trust or distrust, and everything beyond the rules is allowed. A null html has no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
COMMENT = "(?s)<!--.*?-->"
LINK = r'''(?i)(?<![\w-])href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)'''


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matched(rules=RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``, as a struct of rule and verdict, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in reversed(ordered):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def node(host: Column) -> Column:
    """The host in the graph: without user, port and final dot. Rules look at the host as it stands."""
    return F.regexp_replace(F.regexp_replace(F.translate(host, UPPER, LOWER), "^.*@", ""), r"\.?(:\d*)?$", "")


def edges(pages: DataFrame) -> DataFrame:
    """Distinct (source, target) pairs of different nodes; ``pages`` has node and html."""
    shown = F.regexp_replace("html", COMMENT, " ")
    links = pages.select(F.col("node").alias("source"), F.explode(F.regexp_extract_all(shown, F.lit(LINK), 1)).alias("target"))
    links = links.select("source", node(F.col("target")).alias("target"))
    return links.where("source <> '' and target <> '' and source <> target").distinct()


def spread(hosts: DataFrame, links: DataFrame, seed: str, together, rest: float, damping: float, cut: int) -> DataFrame:
    """(host, score): ``1 - damping`` at the hosts where column ``seed`` is true, and what flows along (source, target) pairs, damped.

    ``links`` carries each pair's share of the source's score as ``share``. Scores only grow from round to round, and by ``damping`` less each time in the
    norm ``together`` (F.sum where a source's shares add up to 1, F.max where a target's do), which bounds what is still to come. Lineage is cut
    every ``cut`` rounds.
    """
    score = hosts.select("host", F.when(F.col(seed), F.lit(1 - damping)).otherwise(0.0).alias("score")).withColumn("growth", F.col("score"))
    grown = score.agg(together("growth")).first()[0] or 0.0
    while grown * damping / (1 - damping) > rest:
        for _ in range(cut):
            flow = links.join(score, links.source == score.host).groupBy("target").agg(F.sum(F.col("growth") * F.col("share")).alias("flow"))
            score = score.join(flow, score.host == flow.target, "left").withColumn("growth", F.lit(damping) * F.coalesce("flow", F.lit(0.0)))
            score = score.select("host", (F.col("score") + F.col("growth")).alias("score"), "growth")
        score = stored(score, "rank")
        grown = score.agg(together("growth")).first()[0] or 0.0
    return score.select("host", "score")


def judged(pages: DataFrame, rules=RULES, rest: float = 1e-5, damping: float = 0.85, margin: float = 1.0, floor: float = 1e-4, cut: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust for each row of ``pages`` (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), node(host).alias("node"), path.alias("path"), "html")
    rows = pages.drop("html").withColumn("_rule", matched(rules))
    links = stored(edges(pages.where("html is not null")), "links")
    whole = F.lit(False)
    for verdict, name, _ in (r for r in rules if r[0] == "block" and r[2] == "/"):
        whole = whole | (F.col("host") == name) | F.col("host").endswith("." + name)
    own = rows.groupBy(F.col("node").alias("host")).agg(F.max(F.col("_rule.verdict").eqNullSafe("allow")).alias("trusted"))
    linked = links.select(F.col("source").alias("host")).union(links.select("target")).distinct()
    hosts = own.join(linked, "host", "full").select("host", (F.coalesce("trusted", F.lit(False)) & ~whole).alias("trusted"), whole.alias("blocked"))
    hosts = stored(hosts, "hosts")

    shares = stored(links.join(links.groupBy("source").agg((1.0 / F.count("*")).alias("share")), "source"), "shares")
    trust = spread(hosts, shares, "trusted", F.sum, rest, damping, cut).withColumnRenamed("score", "trust")
    turned = shares.select(F.col("target").alias("source"), F.col("source").alias("target"), "share")
    distrust = spread(hosts, turned, "blocked", F.max, rest, damping, cut).withColumnRenamed("score", "distrust")
    scores = stored(trust.join(distrust, "host").withColumnRenamed("host", "node"), "scores")
    # a host with a third of all pages is no hot key: adaptive execution splits its side of this join, and the other has one row per host
    rows = rows.join(scores, "node", "left")
    method = F.when(F.col("distrust") > margin * F.col("trust") + floor, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"),
                       F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
