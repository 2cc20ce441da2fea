"""URL filters: host and path rules, and trust and distrust spread over the link graph.

A url that rules fit gets the verdict of the longest one. For all others the method decides: trust
starts at hosts with allowed pages and follows links by personalised PageRank; distrust starts at
hosts with blocked pages and follows links backwards (who links to a blocked host is suspect). A host
whose distrust exceeds its trust by more than a share of ``MARGIN`` is blocked. Rounds go on until no
host's score has changed by more than a share of ``TOLERANCE`` since the last scores written, and no
further host has been reached; so the L1 change of all scores is under ``TOLERANCE`` too, and hosts far
from all seeds have scores as exact as near ones.

Edges are counts of links between hosts, from href attributes with a host of their own; links without
a host stay on theirs. A host and the domain above it (of two labels or more) share an owner: an edge of
weight ``OWNER_WEIGHT`` each way, less than a link, joins them, so that hosts without links of their own
take after their domain. Each host keeps one unit of weight for itself, so there are no dead ends. All of it is
DataFrame operations; hosts, not pages, take part in the rounds, and each few rounds are written to the
shared store.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed unless the empty host is distrusted; it takes no part in the graph. A null html has no links.
Repeated rows count as often in seeds and edges. Without seeds all scores are 0. An empty table gives
no rows. Further columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import drop_stash, stash

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING, TOLERANCE, WRITE_EACH, MARGIN, OWNER_WEIGHT = 0.85, 1e-10, 4, 1e-9, 0.1
#: Rounds after which the L1 change is under TOLERANCE on any graph; most need fewer, long chains more.
ROUNDS = math.ceil(math.log(TOLERANCE / 2) / math.log(DAMPING))
HREF = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    start = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, start + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(start > 0, F.translate(host, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    start = F.instr(url, "://")
    rest = F.regexp_replace(F.substring(url, start + 3, F.length(url)), r"^[^/?#]*", "")
    return F.when(start > 0, F.regexp_extract(rest, r"^[^?#]*", 0)).otherwise(F.lit(""))


def _longest_rule(rules) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def match_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    name, verdict = _longest_rule(rules)
    return parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame, *, owner_weight: float = OWNER_WEIGHT) -> DataFrame:
    """src, dst, weight between different hosts."""
    own = F.coalesce(host_of(F.col("url")), F.lit(""))
    links = pages.select(own.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    links = links.select("src", host_of(F.when(F.startswith("href", F.lit("//")), F.concat(F.lit(":"), "href")).otherwise(F.col("href"))).alias("dst"))
    links = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    labels = F.split("host", r"\.")
    hosts = pages.select(own.alias("host")).where("host <> ''").distinct().union(links.select(F.col("dst").alias("host"))).distinct()
    chain = hosts.select(labels.alias("l")).select("l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("k")).where("k < size(l) - 1")
    above = chain.select(F.array_join(F.slice("l", F.col("k"), F.size("l")), ".").alias("src"), F.array_join(F.slice("l", F.col("k") + 1, F.size("l")), ".").alias("dst")).distinct()
    both = above.union(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(owner_weight))
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, *, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust from seeds (host, trust, distrust), each of which sums to 1 or 0."""
    hosts = edges.select(F.col("src").alias("host")).union(seeds.select("host")).distinct()
    edges = edges.union(hosts.select("host", "host", F.lit(1.0)))
    out = edges.groupBy(F.col("src").alias("h")).agg(F.sum("weight").alias("all"))
    back = edges.groupBy(F.col("dst").alias("h")).agg(F.sum("weight").alias("all"))
    ahead = edges.join(out, edges.src == out.h).select("src", "dst", (F.col("weight") / F.col("all")).alias("t"), F.lit(0.0).alias("d"))
    behind = edges.join(back, edges.dst == back.h).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("t"), (F.col("weight") / F.col("all")).alias("d"))
    steps = stash(ahead.union(behind).groupBy("src", "dst").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "steps", narrow=True)
    start = seeds.select("host", *[((1 - damping) * F.col(c)).alias(c) for c in ("trust", "distrust")])
    scores = stash(seeds.select("host", "trust", "distrust"), "scores")
    while True:
        last = scores
        for _ in range(WRITE_EACH):
            sent = steps.join(scores, steps.src == scores.host).select(F.col("dst").alias("host"), (damping * F.col("t") * F.col("trust")).alias("trust"), (damping * F.col("d") * F.col("distrust")).alias("distrust"))
            scores = sent.union(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        scores = stash(scores, "scores", narrow=True)
        old = last.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        moved = lambda new, was: F.abs(F.col(new) - F.coalesce(was, F.lit(0.0))) > tolerance * F.col(new)
        going = scores.join(old, "host", "left").where(moved("trust", "t") | moved("distrust", "d")).limit(1).count()
        drop_stash(last)
        if not going:
            return scores


def judge(pages: DataFrame, rules=RULES, *, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust, reached of each row.

    A host is blocked where its distrust exceeds its trust by more than a share of ``margin``. ``reached``
    says what a verdict rests on: rule, links (the scores of hosts that seeds reach) or nothing.
    """
    ruled = match_rules(pages, rules)
    counts = ruled.where("ruled is not null").groupBy("host").agg(F.sum((F.col("ruled") == "allow").cast("double")).alias("trust"), F.sum((F.col("ruled") == "block").cast("double")).alias("distrust"))
    counts = stash(counts, "seeds")
    trust, distrust = counts.agg(F.sum("trust"), F.sum("distrust")).first()
    seeds = counts.select("host", (F.col("trust") / F.lit(trust or 1.0)).alias("trust"), (F.col("distrust") / F.lit(distrust or 1.0)).alias("distrust"))
    scores = spread(stash(host_edges(pages), "host-edges"), seeds)
    met = ruled.join(scores, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    method = F.when(F.col("distrust") > F.col("trust") * (1 + margin), F.lit("block")).otherwise(F.lit("allow"))
    reached = F.when(F.col("ruled").isNotNull(), "rule").when((F.col("trust") > 0) | (F.col("distrust") > 0), "links").otherwise("nothing")
    return met.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), reached.alias("reached"))


def op10_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
