"""URL filter: host and path rules, and trust that spreads over the links between hosts.

``judge`` parses each url, applies the longest rule that fits, and judges the rest by its host: personalised PageRank
from trusted seeds along the links, and from blocked seeds against them. A host's seed weight is the share of its pages
that an allow (or block) rule covers. A host is blocked if its distrust exceeds both its trust and the uniform share.

Everything is DataFrame operations. Links are summed to (source host, target host) before anything is joined, so a hot
host is one row on the score side and AQE can split it on the link side; the iterations handle hosts, not pages.

Null and odd input: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; null html
has no links, and a very long one is searched whole; repeated rows count as pages of their own; a host whose trust and distrust
are equal is allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

TOLERANCE = 1e-6
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)(?:href|src)\s*=\s*[\x22\x27]?[a-z][a-z0-9+.-]*://([^/?#\x22\x27\s>]*)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, by the length of host and path together; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts that both have pages; ``pages`` needs host and html."""
    found = pages.select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst")
    ).select("src", ascii_lower(F.col("dst")).alias("dst"))
    return found.filter("dst <> '' AND src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(hosts: DataFrame, edges: DataFrame, seed: str, source: str, target: str, damping: float, rounds: int) -> DataFrame:
    """(host, score): personalised PageRank over ``edges`` from ``source`` to ``target``, restarting at ``seed``.

    It ends when three rounds move less than ``TOLERANCE`` of all scores, or after ``rounds``, when damping ** rounds of them may still move.

    Scores add up to 1 (or are all 0): mass that leaves at hosts without outgoing edges returns to the seeds in proportion,
    which in the limit scales all scores alike.
    """
    outs = edges.groupBy(source).agg(F.sum("n").alias("all"))
    step = edges.join(outs, source).select(
        F.col(source).alias("host"), F.col(target).alias("to"), (F.col("n") / F.col("all")).alias("share")
    )
    step = cut(step, "links")
    scores = hosts.select("host", F.col(seed).alias("score"), F.col(seed).alias("seed"))
    if not step.isEmpty():
        scores = scores.withColumn("was", F.col("score"))
        for i in range(rounds):
            got = scores.join(step, "host").groupBy("to").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
            scores = scores.join(got.withColumnRenamed("to", "host"), "host", "left").select(
                "host", (damping * F.coalesce("got", F.lit(0.0)) + (1 - damping) * F.col("seed")).alias("score"), "seed", "was"
            )
            if i % 3 == 2:
                scores = cut(scores, "scores")
                moved, total = scores.agg(F.sum(F.abs(F.col("score") - F.col("was"))), F.sum("score")).first()
                if moved <= TOLERANCE * total:
                    break
                scores = scores.withColumn("was", F.col("score"))
    total = scores.agg(F.sum("score")).first()[0] or 0.0
    return scores.select("host", (F.col("score") / total if total else F.lit(0.0)).alias("score"))


def judge(pages: DataFrame, rules: list[Rule], damping: float = 0.85, rounds: int = 60) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust and distrust of its host."""
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    host, path = F.col("host"), F.col("path")
    ruled = parsed.withColumns(
        {"rule": longest(rules, host, path, lambda r: r.text), "said": longest(rules, host, path, lambda r: r.verdict)}
    )
    share = lambda v: F.avg(F.when(F.col("said") == v, 1.0).otherwise(0.0))
    hosts = cut(
        ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")),
        "hosts",
    )
    known = hosts.select("host")
    edges = cut(
        links(parsed).join(known.withColumnRenamed("host", "src"), "src").join(known.withColumnRenamed("host", "dst"), "dst"),
        "edges",
    )
    trust = spread(hosts, edges, "allowed", "src", "dst", damping, rounds).withColumnRenamed("score", "trust")
    distrust = spread(hosts, edges, "blocked", "dst", "src", damping, rounds).withColumnRenamed("score", "distrust")
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * hosts.count() > 1)
    scores = trust.join(distrust, "host").withColumn("bad", bad)
    by_method = F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")
    return ruled.drop("html").join(cut(scores, "verdicts"), "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", by_method).alias("verdict"), "trust", "distrust"
    )
