"""URL filters: rules, then trust and distrust propagated over host links (native: DataFrame functions only).

The longest rule that fits a url decides it. Hosts are seeds by what the rules decided: personalised
PageRank carries trust from hosts with allowed pages along links, and distrust from hosts with blocked
pages against them (who links to a bad host is suspect). In units of pages, a host's distrust against
its trust, distrust and undecided pages is held to a threshold: at or above it, its other pages are blocked.

A null url, or one without ://, has an empty host and path; that host is a host like any other. Null and
empty html has no links. Links within a host don't count. Rows are judged one by one: repeated rows get
the same verdict. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import if_small, stash, written

#: Verdict, host and path of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING = 0.85
ROUNDS = 20
#: Propagation ends when no more than this share of the mass still moves.
SETTLED = 1e-4
THRESHOLD = 0.5
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does. Of equally long ones, the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """Of pages (url, html): src, dst and weight, the links from one host to another."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank of edges (src, dst, weight) from seeds (host, seed): host, rank.

    Each round a host's rank is its seed plus `damping` times what its sources pass on, each in
    proportion to the weights of its links.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total")).withColumnRenamed("src", "_s")
    shares = stash(edges.join(out, F.col("src") == F.col("_s")).select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    ranks = stash(seeds.select("host", F.col("seed").alias("rank"), F.col("seed").alias("moved")))
    if not shares.limit(1).count():
        return ranks.select("host", "rank")
    for _ in range(rounds):
        # what was added in the last round moves on
        moves = shares.join(ranks.where("moved > 0").select(F.col("host").alias("_h"), "moved"), F.col("src") == F.col("_h"))
        moves = moves.groupBy(F.col("dst").alias("_d")).agg((F.sum(F.col("moved") * F.col("share")) * F.lit(damping)).alias("came"))
        ranks = ranks.drop("moved").join(moves, F.col("host") == F.col("_d"), "full")
        came = F.coalesce("came", F.lit(0.0))
        ranks = written(ranks.select(F.coalesce("host", "_d").alias("host"), (F.coalesce("rank", F.lit(0.0)) + came).alias("rank"), came.alias("moved")), "ranks")  # a checkpoint's size estimate would square each round
        total = ranks.agg(F.sum("rank").alias("rank"), F.sum("moved").alias("moved")).head()
        if not total["rank"] or total["moved"] <= SETTLED * total["rank"]:
            break
    return ranks.select("host", "rank")


def host_scores(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Of pages (url, html): host, trust and distrust (in pages) and blocked."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    per = pages.select(host.alias("host"), ruled(host, path, rules)["verdict"].alias("verdict"))
    count = lambda test: F.count(F.when(test, 1)).cast("double")
    per = stash(per.groupBy("host").agg(count(F.col("verdict") == "allow").alias("allowed"), count(F.col("verdict") == "block").alias("denied"), count(F.col("verdict").isNull()).alias("open")))
    edges = stash(host_links(pages))
    trust = propagate(edges, per.where("allowed > 0").select("host", F.col("allowed").alias("seed")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, per.where("denied > 0").select("host", F.col("denied").alias("seed")))
    out = per.join(trust.select("host", F.col("rank").alias("trust")), "host", "left").join(distrust.select("host", F.col("rank").alias("distrust")), "host", "left")
    out = out.select("host", "open", F.round(F.coalesce("trust", F.lit(0.0)), 6).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 6).alias("distrust"))
    total = F.col("trust") + F.col("distrust") + F.col("open")
    return out.select("host", "trust", "distrust", ((total > 0) & (F.col("distrust") >= F.lit(THRESHOLD) * total)).alias("blocked"))


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The contract's rows for pages (page_id, url, html), with the host's trust and distrust."""
    hosts = stash(host_scores(pages, rules)).withColumnRenamed("host", "_h")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), ruled(host, path, rules).alias("_rule"))
    rows = rows.join(if_small(hosts, 100_000), F.col("host") == F.col("_h"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
