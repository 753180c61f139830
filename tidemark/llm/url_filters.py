"""Verdicts on pages: rules by host and path, and trust and distrust that spread over the links between hosts."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small

#: The part of an absolute or protocol-relative link of an ``a`` or ``area`` element that names its host.
LINK_HOST = r"<[aA](?:[rR][eE][aA])?[\x20\t\n\f\r][^<>]*?[hH][rR][eE][fF][\x20\t\n\f\r]*=[\x20\t\n\f\r]*[\"']?[\x20\t\n\f\r]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\"'<>\x20\t\n\f\r]*)"
#: A whole unit of trust. Masses are whole numbers, so sums don't depend on the order of rows.
UNIT = 1 << 30

Rule = tuple[str, str, str]


def lowered(col: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    return lowered(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (host and path) that fits as a struct of its spelling and verdict, else null."""
    found = F.lit(None).cast("struct<rule:string,said:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("said"))).otherwise(found)
    return found


def spread(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 0.001) -> DataFrame:
    """Personalised PageRank, unnormalised: (side, node, rank) from seeds (side, node, mass) over edges (side, src, dst, weight).

    Mass moves along a node's edges in proportion to their weights, damped at each step; a node's rank is all
    the mass that has reached it. Nodes without edges pass nothing on. Steps end when no mass is left,
    or after as many as damp a unit below ``tolerance``. Masses are rounded down to whole numbers.
    A step joins the mass with the edges (shuffled on the source, so a hub's edges can be split) and is cut by a table.
    """
    out = edges.groupBy(F.col("side").alias("s"), F.col("src").alias("o")).agg(F.sum("weight").alias("out"))
    shares = materialize(edges.join(out, (F.col("side") == F.col("s")) & (F.col("src") == F.col("o"))).select("side", "src", "dst", "weight", "out"), "spread-edges")
    mass = materialize(seeds.where("mass > 0"), "spread-0")
    steps = [mass]
    for k in range(1, ceil(log(tolerance) / log(damping)) + 1):
        at = mass.select(F.col("side").alias("s"), "node", "mass")
        part = F.floor(F.col("mass").cast("double") * F.col("weight").cast("double") / F.col("out").cast("double") * F.lit(damping)).cast("long")
        moved = at.join(shares, (F.col("s") == F.col("side")) & (F.col("node") == F.col("src"))).groupBy("side", F.col("dst").alias("node")).agg(F.sum(part).alias("mass"))
        mass = materialize(moved.where("mass > 0"), f"spread-{k}")
        if mass.isEmpty():
            break
        steps.append(mass)
    ranks = steps[0]
    for step in steps[1:]:
        ranks = ranks.unionByName(step)
    return ranks.groupBy("side", "node").agg(F.sum("mass").alias("rank"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): how many pages of a host link to another, from rows (host, targets)."""
    linked = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode("targets").alias("dst")).where("dst <> '' and dst <> src")
    return linked.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def judge_pages(pages: DataFrame, rules: list[Rule], threshold: float = 0.5, damping: float = 0.85, tolerance: float = 0.001) -> DataFrame:
    """A verdict on every page: its longest fitting rule's, else that of its host's place in the link graph.

    ``rules`` are (allow or block, host, path prefix); one fits its host and all subdomains. A host's trust
    seed is the share of its pages that rules allow, its distrust seed the share that they block. Trust
    spreads along links, distrust against them: a host that distrusted ones are linked from
    isn't distrusted, one that links to them is. A host is blocked if distrust makes up more than ``threshold`` of its trust
    and distrust; a host that neither reaches is allowed. Links are absolute or protocol-relative ones
    of ``a`` and ``area`` elements; a page counts once for a host.

    Returns page_id, host, path, rule (host and path prefix, or null), verdict, and the host's trust
    and distrust in units of a wholly trusted host. Null urls, and those without ``://``, have an empty host and path, which no
    rule fits and no link reaches; null html has no links. Repeated rows count and are judged like others; an empty table gives no rows;
    other columns are ignored.
    """
    if any(verdict not in ("allow", "block") for verdict, *_ in rules):
        raise ValueError("a rule allows or blocks")
    read = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK_HOST), F.lit(1)), lowered)).alias("targets"))
    read = materialize(read.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules)), "pages-read")
    share = lambda verdict: F.floor(F.count(F.when(F.col("found.said") == verdict, 1)) * F.lit(UNIT).cast("double") / F.count(F.lit(1)))
    hosts = read.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block"))
    seeds = hosts.select(F.col("host").alias("node"), F.explode(F.create_map(F.lit("trust"), F.col("allow"), F.lit("distrust"), F.col("block"))).alias("side", "mass")).select("side", "node", "mass")
    edges = materialize(host_edges(read), "host-edges")
    edges = edges.select(F.lit("trust").alias("side"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    ranks = spread(seeds, edges, damping, tolerance)
    rank = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("rank"))), F.lit(0)).alias(side)
    judged = materialize(ranks.groupBy(F.col("node").alias("of")).agg(rank("trust"), rank("distrust")), "host-ranks")
    blocked = F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust"))
    out = read.join(small(judged, "octet_length(of) + 64"), F.col("host") == F.col("of"), "left")
    verdict = F.coalesce(F.col("found.said"), F.when(blocked, "block").otherwise("allow"))
    units = lambda c: (F.coalesce(F.col(c), F.lit(0)) / UNIT).alias(c)
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), units("trust"), units("distrust"))
