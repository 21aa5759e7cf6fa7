"""URL filters: listed rules, and trust and distrust propagated over host edges. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: Verdict, then host and path, as one text; the longest that fits a url decides.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules stand in the plan as one literal; longer lists belong in a table of seeds (see propagate).
MAX_RULES = 1000
#: Mass is counted in whole units, so that sums don't depend on order: of a page's UNIT, BASE enters each round anew.
UNIT, DAMPING = 1_000_000, 85
BASE = UNIT * (100 - DAMPING) // 100
#: Rounds between two stage tables, which cut the lineage.
STAGED = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src)[ \t\r\n]*=[ \t\r\n]*["']?(?:https?:)?//([^/?#"'<> \t\r\n]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; null or without ``://``: both empty."""
    part = lambda n: F.coalesce(F.regexp_extract(url, URL, n), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits a host, or a subdomain, and a path's start; else null. Of
    rules with equal text the first listed counts."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: give seeds as a table instead")
    if not rules:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    made = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = rule.partition("/")
        made.append(F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"), F.lit(name).alias("host"), F.lit(slash + start).alias("path")))
    fits = lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])
    best = F.get(F.filter(F.array(*made), fits), 0)
    return F.when(best.isNotNull(), F.struct(best["verdict"].alias("verdict"), best["rule"].alias("rule")))


def link_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links from pages (url, html) to other hosts. Links without a host stay on their own and
    are no edges."""
    host, _ = url_parts(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.where("src <> '' AND src <> dst").distinct()


def domain_edges(hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst) between each host and the domain it is part of, both ways, up to a domain of two labels. Hosts
    that end in a number have none."""
    labels = F.split("host", r"\.")
    tail = lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), ".")
    named = hosts.where(F.col("host").rlike(r"[a-z][^.]*$") & (F.size(labels) > 2))
    chain = named.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(labels) - 3), lambda i: F.struct(tail(i).alias("low"), tail(i + 1).alias("high")))).alias("x")).distinct()
    return chain.select(F.explode(F.array(F.struct(F.col("x.low").alias("src"), F.col("x.high").alias("dst")), F.struct(F.col("x.high").alias("src"), F.col("x.low").alias("dst")))).alias("e")).select("e.*")


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 20) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` of personalised PageRank with damping 0.85 from ``seeds`` (host, trusted,
    blocked: pages). Trust goes along distinct edges (src, dst), what a host has shared evenly by its links;
    distrust goes against them, shared evenly by those that link to a host. Hosts without mass are left out.

    Mass is in whole millionths of a page (BASE of them enter anew each round), so the result is the same whatever
    order sums are taken in. Both walks are one equi-join and one map-side combined sum a round; a hub's edges
    are a skewed join that AQE splits. Every fifth round is written to the shared folder.
    """
    e = edges.where("src <> dst").distinct()
    walks = e.select(F.lit("trust").alias("walk"), F.col("src").alias("host"), F.col("dst").alias("to")).unionByName(e.select(F.lit("distrust").alias("walk"), F.col("dst").alias("host"), F.col("src").alias("to")))
    walks = stage_table(walks, "walks")
    degrees = walks.groupBy("walk", "host").agg(F.count("*").alias("degree"))
    walks = stage_table(walks.join(degrees, ["walk", "host"]), "degrees")
    base = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("walk"), F.col("trusted").alias("n")), F.struct(F.lit("distrust").alias("walk"), F.col("blocked").alias("n")))).alias("s"))
    base = stage_table(base.where("s.n > 0").select("s.walk", "host", (F.col("s.n") * BASE).alias("mass")), "seeds")
    mass = base
    for n in range(rounds):
        share = F.expr(f"(mass DIV 100) * {DAMPING} DIV degree")
        moved = walks.join(mass, ["walk", "host"]).select("walk", F.col("to").alias("host"), share.alias("mass"))
        mass = moved.where("mass > 0").unionByName(base).groupBy("walk", "host").agg(F.sum("mass").alias("mass"))
        if n % STAGED == STAGED - 1:
            mass = stage_table(mass, "mass")
    of = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("mass"))), F.lit(0)).alias(walk)
    return mass.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, rounds: int = 20, most_percent: int = 30) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``.

    A rule that fits decides (see rule_of). For other pages their host does: hosts are seeds by how many of their pages
    rules allow (trusted) and block; over links between hosts and edges to their domains trust is propagated
    forwards and distrust backwards (see propagate). A host is blocked if distrust exceeds trust by more than
    ``most_percent`` per cent of the mass that its pages would have if all were seeds; hosts that neither reaches are allowed.

    Null url, or none with ``://``: host and path empty, no rule, no part in the graph, allowed. A host with a port or a
    user name is a host like others. Null html: no links. Null page_id, repeated rows: rows like others (repeats
    count as pages). Empty table: no rows. Only page_id, url and html are read, so other columns may have any name.
    Urls are parsed where they are read; hosts are counted map-side, and only hosts that are blocked are
    joined back, an equi-join on the host that AQE broadcasts or splits.
    """
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "fit.rule", "fit.verdict")
    counts = p.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("trusted"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    counts = stage_table(counts, "hosts")
    links = stage_table(link_edges(pages), "links")
    hosts = counts.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    ranks = propagate(links.unionByName(domain_edges(hosts)), counts, rounds)
    spare = (F.col("distrust") - F.col("trust")).cast("decimal(38,0)") * 100 > F.col("pages").cast("decimal(38,0)") * (BASE * most_percent)
    known = counts.join(ranks, "host").select(F.col("host").alias("at"), "trust", "distrust", spare.alias("bad"))
    out = p.join(known, p["host"] == known["at"], "left")
    verdict = F.coalesce("verdict", F.when(F.col("bad"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
