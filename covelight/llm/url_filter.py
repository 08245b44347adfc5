"""URL verdicts from rules and from trust that spreads over links between hosts.

Rules (host, path) block or allow a url whose host is the rule's or below it and whose path starts with the rule's;
the longest (host and path together) wins, ties going to block. For the rest, a personalised PageRank walks along
links from the hosts of which the rules allow a page, and another against links from the hosts of which they block
one, each host weighted by its share of such pages: a host that links to bad hosts is suspect. A host is blocked when
its distrust is over `ratio` times its trust and over `least` times an even share; its own seed counts in this only where
the rules decide so on at least half of its pages, so a few blocked paths do not block the rest of their host. Links are the absolute and scheme-relative hrefs in the pages. All scores stay in tables.

A null url, or one without `://`, has an empty host and path, fits no rule and takes the method's verdict for the
empty host (allow unless links say otherwise); a null html has no links. Repeated rows repeat their links and get equal results; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))


def _after(url: str | Column) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    at = F.instr(c, "://")
    return F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise(F.lit(""))


def host_of(url: str | Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UP, _LOW), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null where none does. The few rules become one CASE."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; pages has host and html."""
    href = F.regexp_extract_all("html", F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*((?:https?:)?//[^\s\"'>]+)"), F.lit(1))
    found = pages.select(F.col("host").alias("src"), F.explode(href).alias("url"))
    full = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    return found.select("src", host_of(full).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


#: Part of a score that goes on over links each round.
DAMPING = 0.85


def spread(links: DataFrame, seeds: DataFrame, rounds: int = 12, damping: float = DAMPING) -> DataFrame:
    """(host, score): personalised PageRank over links (src, dst, n) from seeds (host, weight), cut every four rounds."""
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    edges = cut(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    total = seeds.agg(F.sum("weight")).first()[0] or 0.0
    start = cut(seeds.select("host", (F.col("weight") / F.lit(total or 1.0)).alias("start")))
    score = start.withColumnRenamed("start", "score")
    if not edges.limit(1).count():
        return score.withColumn("score", F.col("score") * (1 - damping))
    for i in range(rounds):
        flow = score.join(edges, score["host"] == edges["src"]).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("part"))
        score = flow.union(start.select("host", F.col("start") * (1 - damping))).groupBy("host").agg(F.sum("part").alias("score"))
        if i % 4 == 3:
            score = cut(score)
    return score


def judge_urls(df: DataFrame, rules: tuple[UrlRule, ...] = RULES, ratio: float = 1.0, least: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, trust, distrust."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"), F.col(html_col).cast("string").alias("html"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.select("page_id", "host", "path", name.alias("rule"), verdict.alias("said"))
    hosts = cut(ruled.groupBy("host").agg(F.sum((F.col("said") == "allow").cast("double")).alias("good"), F.sum((F.col("said") == "block").cast("double")).alias("bad"), F.count(F.lit(1)).alias("pages")))
    links = cut(host_links(pages))
    shares = {"trust": F.coalesce(F.col("good"), F.lit(0.0)) / F.col("pages"), "distrust": F.coalesce(F.col("bad"), F.lit(0.0)) / F.col("pages")}
    seeds = lambda score: hosts.select("host", shares[score].alias("weight")).where("weight > 0")
    trust = spread(links, seeds("trust")).withColumnRenamed("score", "trust")
    distrust = spread(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds("distrust")).withColumnRenamed("score", "distrust")
    totals = hosts.agg(F.count(F.lit(1)).alias("hosts"), *(F.sum(share).alias(score) for score, share in shares.items())).first()
    even = 1.0 / max(totals["hosts"], 1)
    known = hosts.join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    # What a host's own seed gave it is taken off again where the rules decide so on under half of its pages.
    weighed = {score: F.col(score) - F.when(share < 0.5, share * ((1 - DAMPING) / (totals[score] or 1.0))).otherwise(0.0) for score, share in shares.items()}
    suspect = (weighed["distrust"] > ratio * weighed["trust"]) & (weighed["distrust"] > least * even)
    judged = cut(known.select("host", "trust", "distrust", suspect.alias("suspect")))
    # A host with a third of all rows is a skewed partition of this join, which AQE splits.
    both = ruled.join(judged, "host", "left")
    said = F.coalesce("said", F.when(F.col("suspect"), F.lit("block")).otherwise(F.lit("allow")))
    return both.select("page_id", "host", "path", "rule", said.alias("verdict"), "trust", "distrust")
