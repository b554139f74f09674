"""URL filters: prefix rules first, then trust and distrust spread over the host graph.

Only Spark columns and joins. Rules seed the graph: a host's teleport mass is the number
of its pages that an allow rule (trust) or a block rule (distrust) fits. Trust follows
links forward, distrust follows them backward (who links to blocked hosts is suspect).
A host whose distrust exceeds `ratio` times its trust is blocked; a host that neither
reaches is allowed.

Links are reduced to distinct host pairs before anything is joined, so a host that holds a
third of all pages costs one row per neighbour. Each round is written to the shared folder.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainshift.llm.textnorm import ascii_lower
from strainshift.session import materialise

#: (rule, verdict): host and path prefix, as the contract gives them.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
#: Comments and scripts, to the end of the page where nothing ends them, hold no links.
NO_LINKS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)"
LINK = r"""(?is)<a\s(?:[^<>]*?[\s"'])?href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' for null or no ://."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (src, dst) pairs of different hosts that a link of a page connects.

    Links are href attributes of `a` outside comments and scripts.
    """
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(
        F.regexp_replace(F.coalesce(F.col(html), F.lit("")), NO_LINKS, " "), F.lit(LINK), F.lit(1)))).alias("href"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    links = links.select("src", host_of(full).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").distinct()


def spread(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int | None = None,
           tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust): personalised PageRank and its reverse, from the seeds' mass.

    seeds has host, good, bad. Mass at a host without (reversed) links leaves the walk.
    Values only grow. Stops when none grew by more than `tolerance` of itself, so not while a
    host is reached for the first time, however much mass other hosts have; `rounds` can end
    it before. Mass thins out on its way: below about 1e-308 it is 0.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    into = edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    edges = materialise(edges.join(out, "src").join(into, "dst").select(
        "src", "dst", (damping / F.col("n_out")).alias("w_out"), (damping / F.col("n_in")).alias("w_in")))
    nodes = seeds.select("host", "good", "bad").unionByName(
        edges.select(F.explode(F.array("src", "dst")).alias("host"),
                     F.lit(0.0).alias("good"), F.lit(0.0).alias("bad")))
    nodes = materialise(nodes.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    ranks = nodes.select("host", "good", "bad", (F.col("good") * (1 - damping)).alias("trust"),
                         (F.col("bad") * (1 - damping)).alias("distrust"))
    if edges.isEmpty():
        return ranks.select("host", "trust", "distrust")
    ranks = materialise(ranks)
    grown = lambda new, old: F.when(new > old, (new - old) / new).otherwise(0.0)
    for _ in itertools.count() if rounds is None else range(rounds):
        forward = edges.join(ranks, F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("w_out")).alias("t"), F.lit(0.0).alias("d"))
        backward = edges.join(ranks, F.col("dst") == F.col("host")).select(
            F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("w_in")).alias("d"))
        flow = forward.unionByName(backward).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        trust = F.col("good") * (1 - damping) + F.coalesce("t", F.lit(0.0))
        distrust = F.col("bad") * (1 - damping) + F.coalesce("d", F.lit(0.0))
        new = materialise(ranks.join(flow, "host", "left").select(
            "host", "good", "bad", trust.alias("trust"), distrust.alias("distrust"),
            F.greatest(grown(trust, F.col("trust")), grown(distrust, F.col("distrust"))).alias("grown")))
        moved = new.agg(F.max("grown")).first()[0]
        ranks = new.drop("grown")
        if moved <= tolerance:
            break
    return ranks.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html",
               rules=RULES, ratio: float = 1.0) -> DataFrame:
    """Per page: page, host, path, rule, verdict, trust, distrust.

    A null url, or one without ://, has empty host and path, no rule and is allowed, since
    nothing speaks against it. Null html has no links. Repeated rows are judged each.
    """
    parts = pages.select(F.col(page).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    count = lambda v: F.sum(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0))
    seeds = parts.where("host <> ''").groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad"))
    ranks = spread(seeds, host_edges(pages, url, html)).withColumnRenamed("host", "r_host")
    judged = parts.join(ranks, parts["host"] == F.col("r_host"), "left")
    method = F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow")
    return judged.select(F.col("page").alias(page), "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce("fit.verdict", method).alias("verdict"),
                         F.coalesce("trust", F.lit(0.0)).alias("trust"),
                         F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
