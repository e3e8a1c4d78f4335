"""URL filters: rules first, then trust and distrust propagated over the graph of host links.

Rules name a host and a path prefix, fit subdomains too, and the longest wins.  What no rule fits is judged by
its host: personalised PageRank spreads trust along links from hosts with allowed pages, and distrust along
reversed links from hosts with blocked pages (who links to a bad host is suspect).  Seeds weigh by their pages.
A host is blocked if its distrust exceeds ``ratio`` times its trust; hosts that neither reaches are allowed.

Edges are the distinct pairs of different hosts of absolute or protocol-relative ``href`` values, aggregated on
the map side.  Each iteration joins edges with ranks on the link's source (or target) and sums by target (or
source), so a hub costs a skewed join at most, which Spark splits; ranks are checkpointed every iteration.  Without
a number of ``iterations`` they go on until no rank changes by ``TOLERANCE``; what is then still on its way is less
than the margin of the verdict, however long the chains of links are.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is allowed unless
its (empty) host is blocked, which can't be; null html has no links; repeated rows weigh each for itself as
seeds and are judged alike; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark as S

ITERATIONS, DAMPING, RATIO = 12, 0.85, 1.0  # the SQL unrolls so many
TOLERANCE = 1e-13
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path

    @classmethod
    def of(cls, text: str) -> Rule:
        """From "allow example.com/en/7" or "block com/en/"."""
        verdict, _, where = text.partition(" ")
        m = re.fullmatch(r"([^/]+)(/.*)?", where)
        if verdict not in ("allow", "block") or not m:
            raise ValueError(f"not a rule: {text!r}")
        return cls(m[1], m[2] or "", verdict == "allow")


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _AZ, _AZ.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule's name, else null."""
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in rules]
    return F.coalesce(*(F.when(f, F.lit(r.name)) for r, f in sorted(zip(rules, fits, strict=True), key=lambda x: -len(x[0].name))), F.lit(None).cast("string"))


def links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of different hosts."""
    found = pages.where("html LIKE '%//%'").select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("to"))
    found = found.where(F.col("to").rlike(r"^(?i:https?:)?//"))
    dst = host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to")))
    return found.select("src", dst.alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, iterations: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust).  ``seeds``: host, allowed, blocked (pages); each rank sums to 1 if it has seeds.

    Rank that reaches a host without onward links goes back to the seeds.
    """
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    share = lambda c, n: (F.col(c) / F.lit(float(n))) if n else F.lit(0.0)
    seeds = S.kept(seeds.where("allowed + blocked > 0").select("host", share("allowed", total.a).alias("s"), share("blocked", total.b).alias("z")))
    if edges.isEmpty():
        return seeds.select("host", F.col("s").alias("trust"), F.col("z").alias("distrust"))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    into = edges.groupBy("dst").agg(F.count("*").alias("into"))
    edges = S.kept(edges.join(out, "src").join(into, "dst"))
    hosts = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).unionByName(seeds.select("host")).distinct()
    hosts = S.kept(hosts.join(seeds, "host", "left").na.fill(0.0).join(out.withColumnRenamed("src", "host"), "host", "left").join(into.withColumnRenamed("dst", "host"), "host", "left"))
    ranks = hosts.select("host", F.col("s").alias("trust"), F.col("z").alias("distrust"), F.lit(1.0).alias("change"))
    for _ in itertools.count() if iterations is None else range(iterations):
        forth = edges.join(ranks.select(F.col("host").alias("src"), "trust"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("trust") / F.col("out")).alias("t"))
        back = edges.join(ranks.select(F.col("host").alias("dst"), "distrust"), "dst").groupBy(F.col("src").alias("host")).agg(F.sum(F.col("distrust") / F.col("into")).alias("d"))
        stuck = hosts.join(ranks, "host").agg(F.sum(F.when(F.col("out").isNull(), F.col("trust"))).alias("t"), F.sum(F.when(F.col("into").isNull(), F.col("distrust"))).alias("d"), F.max("change").alias("change")).first()
        if iterations is None and stuck.change < TOLERANCE:
            break
        step = lambda got, seed, lost: (1 - damping + damping * (lost or 0.0)) * F.col(seed) + damping * F.coalesce(F.col(got), F.lit(0.0))
        trust, distrust = step("t", "s", stuck.t), step("d", "z", stuck.d)
        change = F.greatest(F.abs(trust - F.col("trust")), F.abs(distrust - F.col("distrust")))
        ranks = S.kept(hosts.join(ranks.drop("change"), "host").join(forth, "host", "left").join(back, "host", "left").select("host", trust.alias("trust"), distrust.alias("distrust"), change.alias("change")))
    return ranks.drop("change")


def judge(pages: DataFrame, rules: list[str], iterations: int | None = None, damping: float = DAMPING, ratio: float = RATIO, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    known = [Rule.of(r) for r in rules]
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), known))
    allowed = F.col("rule").isin([r.name for r in known if r.allow])
    seeds = own.where("rule IS NOT NULL").groupBy("host").agg(F.count_if(allowed).alias("allowed"), F.count_if(~allowed).alias("blocked"))
    edges = S.kept(links(pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))))
    ranks = propagate(edges, S.kept(seeds), iterations, damping)
    bad = ranks.where(F.col("distrust") > ratio * F.col("trust") + 1e-12).select("host", F.lit(True).alias("bad"))
    by_rule = F.when(F.col("rule").isNull(), None).when(allowed, "allow").otherwise("block")
    verdict = F.coalesce(by_rule, F.when(F.col("bad"), "block"), F.lit("allow"))
    return own.join(bad, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
