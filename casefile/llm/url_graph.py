"""URL verdicts by rules and, where none fits, by trust and distrust over the graph of hosts.

All native DataFrame functions. Trust is personalised PageRank from hosts with allowed pages, along
links; distrust from hosts with blocked pages, against them. Ranks are whole numbers (parts of
SCALE), so sums don't depend on their order and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.llm.common import cut, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 10**15
ROUNDS, DAMPING, EVERY = 10, 85, 5
#: Absolute and protocol-relative links; relative ones stay on their host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest fitting rule; of two as long as each other, the first in order."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        same = (host == name) | host.endswith("." + name)
        fits.append(F.when(same & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and w: links between different hosts. Counted by page first (map side)."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host and rank of personalised PageRank along ``edges`` (src, dst, w) from ``seeds`` (host,
    n): in each round a host keeps 15 % of its seed share and gets 85 % of its sources' ranks, by
    weight. Rank that meets a host without links on ends there."""
    total = seeds.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    share = seeds.select("host", F.expr(f"({SCALE} div {max(1, total['n'] or 0)}) * n").alias("seed"))
    out = edges.groupBy("src").agg(F.sum("w").alias("out"))
    flow = written(edges.join(out, "src"), "flow")  # read in each round
    rank = share.select("host", F.col("seed").alias("rank"))
    for k in range(rounds):
        sent = flow.join(rank, flow["src"] == rank["host"]).select(F.col("dst").alias("host"), F.expr(f"(rank * {DAMPING} div 100 div out) * w").alias("rank"))
        kept = share.select("host", F.expr(f"seed * {100 - DAMPING} div 100").alias("rank"))
        rank = sent.unionByName(kept).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % EVERY == EVERY - 1:
            rank = cut(rank)
    return rank


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page.

    ``pages`` has page_id, url and html; other columns are ignored. ``rules`` are (verdict, host and
    path) pairs; a rule fits its host and subdomains where the path starts with its own, and the
    longest wins. Without a rule the host decides: block if its distrust exceeds its trust, else
    allow. Null urls, and urls without ``://``, have empty host and path, so no rule and no graph:
    allowed. A null html has no links. Repeated rows count as pages of their own. An empty table
    gives an empty result.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    verdicts = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)]) if rules else F.lit(None).cast("map<string,string>")
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "url").withColumn("rule", rule_of(rules, F.col("host"), F.col("path")))
    judged = judged.withColumn("ruled", verdicts[F.col("rule")]).drop("url")
    seeds = judged.filter("host <> '' and ruled is not null").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    seeds = cut(seeds)
    edges = written(host_edges(pages), "edges")
    rounds = rounds if edges.take(1) else 1
    trust = propagate(edges, seeds.filter("allowed > 0").select("host", F.col("allowed").alias("n")), rounds).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = propagate(back, seeds.filter("blocked > 0").select("host", F.col("blocked").alias("n")), rounds).withColumnRenamed("rank", "distrust")
    ranks = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    out = judged.join(ranks, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0))).withColumn("distrust", F.coalesce("distrust", F.lit(0)))
    method = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
