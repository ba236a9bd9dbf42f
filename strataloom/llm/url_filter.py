"""URL filter: rules on hosts and paths, and for the rest trust and distrust that spread over the link graph.

DataFrame functions only. Pages' links become weighted edges between hosts, summed before any join. Trust is a
personalised PageRank from hosts that allow-rules name, along the links; distrust the same from blocked hosts against
them. A host's standing is its share of trust in both; below the threshold its pages are blocked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

LINK = r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)"""
#: Lower-case `A` to `Z` only, whatever the locale or script.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: STEPS are those of the SQL form, which can't iterate to the end.
DAMPING, STEPS, THRESHOLD, DIGITS = 0.85, 12, 0.5, 9
#: Ranks have settled when no host's differs by more than this share of itself between looks; rounds allowed until then,
#: and rounds between two looks.
TOLERANCE, ROUNDS, LOOK = 1e-9, 1000, 4


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty if there is no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (name, verdict); null if none does. Of equally long ones the first by name."""
    found: Column = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(src, dst, n, allow, block): links between hosts, from rows (host, html), and those whose own target a rule allows or
    blocks. A link without a host of its own stays on its page's and is left to that page's rule, as is one to that host."""
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    own = link.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*)://")
    dst = F.when(own, host_of(link)).otherwise(
        F.when(F.col("link").rlike(r"^(mailto|javascript|data|tel):"), F.lit("")).otherwise(F.col("host"))
    )
    edges = links.select(F.col("host").alias("src"), dst.alias("dst"), F.when(own, path_of(link)).alias("path")).where("dst <> ''")
    verdict = F.when(F.col("path").isNotNull() & (F.col("src") != F.col("dst")), rule_of(F.col("dst"), F.col("path"), rules)["verdict"])
    edges = edges.groupBy("src", "dst", verdict.alias("verdict")).agg(F.count("*").alias("n"))
    told = [F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")]
    return edges.groupBy("src", "dst").agg(F.sum("n").alias("n"), *told)


def _shares(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst, p): what part of its rank a host passes on along each edge."""
    total = edges.groupBy("src").agg(F.sum("n").alias("all"))
    return scratch.keep(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("p")), "shares")


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): rank = (1 - damping) seed + damping * what the edges (src, dst, n) bring, iterated from the seeds until
    no host is new and no rank changes by more than `tolerance` of itself. An error if `rounds` rounds don't do.

    seeds: (host, seed) with seeds that sum to 1. What a host without an edge out would pass on is dropped.
    """
    return _settled(_shares(edges, scratch), seeds, scratch, damping, tolerance, rounds)


def _settled(share: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    kept = seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))
    before = scratch.keep(seeds.select("host", F.col("seed").alias("rank")), "rank")
    for _ in range(-(-rounds // LOOK)):
        now = before
        for _ in range(LOOK):
            brought = share.join(now, share["src"] == now["host"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("p") * damping).alias("rank"))
            now = kept.unionByName(brought).groupBy("host").agg(F.sum("rank").alias("rank"))
        now = scratch.keep(now, "rank")
        was = F.coalesce("was", F.lit(0.0))
        moved = now.join(before.withColumnRenamed("rank", "was"), "host", "left").where(F.abs(F.col("rank") - was) > tolerance * F.col("rank"))
        settled = moved.isEmpty()
        scratch.drop(before)
        if settled:
            return now
        before = now
    raise RuntimeError(f"ranks did not settle in {rounds} rounds")


def log_ranks(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float) -> DataFrame:
    """(host, log_rank): the natural logarithms of propagate()'s ranks, for hosts that have one.

    A host that is no seed and has one edge in passes a fixed share of one other host's rank on, so chains of such hosts, as
    calendars and link farms make them, are taken together first: each finds the host that its chain begins at by steps that
    double, and the logarithm of its share. Only the others are iterated. What leads back to itself without a seed has no rank.
    """
    share = _shares(edges, scratch)
    ins = share.groupBy("dst").agg(F.count("*").alias("ins"), F.first("src").alias("root"), F.first("p").alias("p")).where("ins = 1")
    ins = ins.join(seeds.select(F.col("host").alias("dst")), "dst", "left_anti")
    chains = scratch.keep(ins.select(F.col("dst").alias("host"), "root", (F.log("p") + math.log(damping)).alias("f")), "chains")
    hosts = chains.select(F.col("host").alias("passes"))
    for _ in range(chains.count().bit_length() + 1):
        if chains.join(hosts, F.col("root") == F.col("passes"), "left_semi").isEmpty():
            break
        next_ = chains.select(F.col("host").alias("root"), F.col("root").alias("far"), F.col("f").alias("g"))
        longer = chains.join(next_, "root", "left").select("host", F.coalesce("far", "root").alias("root"), (F.col("f") + F.coalesce("g", F.lit(0.0))).alias("f"))
        chains = scratch.keep(longer, "chains")
    # what still stands on a host that passes on is a cycle, or hangs on one
    chains = chains.join(hosts, F.col("root") == F.col("passes"), "left_anti")
    rest = share.join(hosts, F.col("dst") == F.col("passes"), "left_anti")
    plain = rest.join(hosts, F.col("src") == F.col("passes"), "left_anti")
    through = rest.join(chains, F.col("src") == F.col("host")).select(F.col("root").alias("src"), "dst", (F.col("p") * F.exp("f")).alias("p"))
    short = scratch.keep(plain.unionByName(through).groupBy("src", "dst").agg(F.sum("p").alias("p")), "short")
    ranks = _settled(short, seeds, scratch, damping).where("rank > 0").select("host", F.log("rank").alias("log_rank"))
    passed = chains.join(ranks.withColumnRenamed("host", "root"), "root").select("host", (F.col("log_rank") + F.col("f")).alias("log_rank"))
    return scratch.keep(ranks.unionByName(passed), "log-ranks")


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    damping: float = DAMPING,
    threshold: float = THRESHOLD,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, trust.

    Null urls and urls without `://` have empty host and path, no rule, and the verdict of an unknown host: allow. Null
    pages link nowhere. `trust` is the host's share of trust, 0.5 for a host that neither reaches. A host seeds trust by
    the share of its allowed pages, and of links to it from other hosts whose target a rule allows, among all of these;
    distrust likewise. So hosts without pages seed too. Repeated rows count each. Very long pages are read whole. Other
    columns are not looked at. An empty table gives no rows.
    """
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    host, path = host_of(F.col(url)), path_of(F.col(url))
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    base = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    edges = scratch.keep(host_edges(base, rules), "edges")
    ruled = base.where("hit is not null and host <> ''").groupBy("host", F.col("hit.verdict").alias("verdict")).agg(F.count("*").alias("n"))
    for verdict in ("allow", "block"):
        ruled = ruled.unionByName(edges.where(F.col(verdict) > 0).select(F.col("dst").alias("host"), F.lit(verdict).alias("verdict"), F.col(verdict).alias("n")))
    ruled = scratch.keep(ruled.groupBy("host", "verdict").agg(F.sum("n").alias("n")), "seeds")
    ranks = []
    for verdict, way in (("allow", edges), ("block", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))):
        own = ruled.where(F.col("verdict") == verdict)
        total = own.agg(F.sum("n")).first()[0] or 1
        seeds = own.select("host", (F.col("n") / F.lit(total)).alias("seed"))
        ranks.append(log_ranks(way, seeds, scratch, damping))
    trust = ranks[0].withColumnRenamed("log_rank", "t").join(ranks[1].withColumnRenamed("log_rank", "d"), "host", "full")
    # t / (t + d) of the ranks themselves, which may be too small for a number
    of_both = F.when(F.col("d").isNull(), 1.0).when(F.col("t").isNull(), 0.0).otherwise(1 / (1 + F.exp(F.col("d") - F.col("t"))))
    # rounded, so that the order in which ranks are summed can't turn a verdict
    standing = scratch.keep(trust.select("host", F.round(of_both, DIGITS).alias("trust")), "standing")
    out = base.drop("html").join(small(standing), "host", "left")
    told = F.when(F.coalesce("trust", F.lit(0.5)) >= threshold, "allow").otherwise("block")
    return out.select(
        "page_id", "host", "path", F.col("hit.name").alias("rule"), F.coalesce(F.col("hit.verdict"), told).alias("verdict"), F.coalesce("trust", F.lit(0.5)).alias("trust")
    )
