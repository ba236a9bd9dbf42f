"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every document gets a rate r = CAP / (1 + exp(-lambda * size / mean)), the exponential tilt that maximises the entropy
of copies between 0 and CAP around an even draw, under one token constraint per source: the sum of rate times size is
the source's target. The convex dual separates by source; its Newton steps are grouped sums over a histogram of sizes,
which says all the dual needs, since documents of one source and size share a rate. Rates become whole copies by error
diffusion inside bounded chunks, largest documents first, so that small ones make up for what large ones miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, null_key, small

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
CAP = 2
#: Beyond this tilt a rate is its bound to a double's precision for any size near the mean.
STEEPEST = 400.0
#: Rows that one rounding chunk holds on average.
CHUNK = 1024


def word_count(text: Column) -> Column:
    """Words parted by ASCII white space; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(sn, sk, source_size, target) per source: shares by weight, filled up to cap times the source's size.

    Filling to a common level is solved in closed form: sources in ascending order of cap per weight are capped as long
    as the level that the rest would then get lies above theirs. One row per source passes through the window.
    """
    from pyspark.sql import Window as W

    per = sizes.groupBy("sn", "sk").agg(F.sum("size").alias("source_size"))
    # the numbering needs the code-point order of all sources; UTF8 binary order is code-point order
    order = per.withColumn("i", F.row_number().over(W.orderBy("sn", "sk")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    top = order.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    line = W.orderBy(F.col("top") / F.col("w"), "i")
    before = top.withColumn("done", F.coalesce(F.sum("top").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    before = before.withColumn("left_w", F.sum("w").over(line.rowsBetween(0, W.unboundedFollowing)))
    before = before.withColumn("goal", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    level = before.withColumn("level", (F.col("goal") - F.col("done")) / F.col("left_w"))
    level = level.withColumn("full", F.col("level") * F.col("w") >= F.col("top"))
    first = F.min(F.when(~F.col("full"), F.struct((F.col("top") / F.col("w")).alias("x"), "i", "level"))).over(W.partitionBy())
    level = level.withColumn("open", first)
    target = F.when(F.col("open").isNull(), F.col("top")).otherwise(F.least(F.col("top"), F.col("open.level") * F.col("w")))
    return scratch.keep(level.select("sn", "sk", "source_size", target.alias("target")), "targets")


def _rate(tilt: Column, z: Column, cap: float) -> Column:
    x = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * z))
    return F.lit(float(cap)) / (F.lit(1.0) + F.exp(-x))


def solve_tilts(hist: DataFrame, targets: DataFrame, scratch: Scratch, cap: float, steps: int = 60, tol: float = 1e-7) -> DataFrame:
    """(sn, sk, mean, tilt): Newton on the dual, kept inside a shrinking bracket so that it can't overshoot.

    A target of nothing or of cap times the source has its optimum at an infinite tilt, given as null with `edge` set to
    the rate there.
    """
    mean = hist.groupBy("sn", "sk").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    now = targets.join(mean, ["sn", "sk"], "left")
    edge = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= F.col("source_size") * cap * (1 - 1e-12), float(cap))
    now = now.withColumn("edge", edge).withColumn("tilt", F.lit(0.0))
    now = scratch.keep(now.withColumn("lo", F.lit(-STEEPEST)).withColumn("hi", F.lit(STEEPEST)), "tilts")
    hist = hist.where("size > 0")
    few = now.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for _ in range(steps):
        z = F.col("size") / F.col("mean")
        r = _rate(F.col("tilt"), z, cap)
        mass = F.col("n") * F.col("size")
        tilts = now.where("edge is null").select("sn", "sk", "mean", "tilt")
        sums = (
            hist.join(F.broadcast(tilts) if few else tilts, ["sn", "sk"])
            .groupBy("sn", "sk")
            .agg(F.sum(mass * r).alias("got"), F.sum(mass * z * r * (1 - r / F.lit(float(cap)))).alias("slope"))
        )
        both = now.join(sums, ["sn", "sk"], "left")
        gap = F.col("got") - F.col("target")
        both = both.withColumn("gap", gap).withColumn("lo", F.when(F.col("gap") <= 0, F.col("tilt")).otherwise(F.col("lo")))
        both = both.withColumn("hi", F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("hi")))
        step = F.when(F.col("slope") > 0, F.col("tilt") - F.col("gap") / F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        both = both.withColumn("off", F.abs(F.col("gap")) / F.greatest(F.col("target"), F.lit(1.0)))
        both = both.withColumn(
            "tilt",
            F.when(F.col("off").isNull() | (F.col("off") <= tol), F.col("tilt"))
            .when(inside, step)
            .otherwise((F.col("lo") + F.col("hi")) / 2),
        )
        after = scratch.keep(both.select(*now.columns, "off"), "tilts")
        worst = after.agg(F.max("off")).first()[0]
        scratch.drop(now)
        now = after.drop("off")
        scratch.paths[id(now)] = scratch.paths.pop(id(after))
        if worst is None or worst <= tol:
            return now
    raise RuntimeError(f"a source's words are off by {worst:.2e} of its target after {steps} steps")


def _repeated(rows: DataFrame, times: str, nth: str) -> DataFrame:
    """Each row as often as `times` says, numbered from 0; in two steps, so that no array is long."""
    parts = rows.withColumn("__part", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / CHUNK))))
    first = F.col("__part") * CHUNK
    return parts.withColumn(nth, F.explode(F.sequence(first, F.least(first + CHUNK, F.col(times)) - 1))).drop("__part")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (sn, sk, doc_id, carried, size, docs, ...) with the rounding chunk of each. Equal rows are numbered among
    themselves, so that they too spread over all chunks of their source, alike in every run."""
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("__same"))
    each = _repeated(same, "__same", "__nth")
    chunk = F.pmod(F.xxhash64("doc_id", "carried", "size", "__nth"), F.ceil(F.col("docs") / F.lit(CHUNK)))
    return each.withColumn("chunk", chunk).drop("__same", "__nth")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = CAP,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    carry: Column | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, carried, size, source_size, target, rate, copies, taken.

    `carried` is a column of the caller's (long), or 0.

    Sources stand in code-point order, null last, and take `weights` in turn. Null or empty texts have size 0, rate 0 and
    no copy. Rows that repeat are rows of their own. Of documents of one size, which of them is taken more often is left
    to their ids. Very long texts are counted whole; one that is larger than its source's target may be taken or not.
    Sources whose texts are all empty have target 0. An empty table gives an empty result. Equal input gives equal output:
    chunks and orders come from hashes and values alone. An error if a tilt can't be found.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    sn, sk = null_key(F.col(source).cast("string"))
    rows = scratch.keep(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.lit(0) if carry is None else carry).cast("long").alias("carried"),
            sn.alias("sn"),
            sk.alias("sk"),
            word_count(F.col(text)).alias("size"),
        ),
        "sizes",
    )
    hist = scratch.keep(rows.groupBy("sn", "sk", "size").agg(F.count("*").alias("n")), "histogram")
    weighed = hist.select("sn", "sk", (F.col("size") * F.col("n")).alias("size"))
    targets = source_targets(weighed, scratch, weights, share, cap)
    tilts = solve_tilts(hist, targets, scratch, cap)
    per = tilts.join(hist.groupBy("sn", "sk").agg(F.sum("n").alias("docs")), ["sn", "sk"])
    per = scratch.keep(per.select("sn", "sk", "source_size", "target", "mean", "tilt", "edge", "docs"), "rates")
    # the sources' table is broadcast if it is small; otherwise adaptive execution splits a hot source in the join
    rated = rows.join(small(per), ["sn", "sk"])
    rate = F.when(F.col("size") == 0, 0.0).otherwise(
        F.coalesce("edge", _rate(F.col("tilt"), F.col("size") / F.col("mean"), cap))
    )
    rated = _dealt(rated.withColumn("rate", rate).select("sn", "sk", "doc_id", "carried", "size", "rate", "docs", "source_size", "target"))
    item = F.struct((-F.col("size")).alias("by"), "doc_id", "carried", "size", "rate")
    grouped = rated.groupBy("sn", "sk", "chunk").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sort_array(F.collect_list(item)).alias("items")
    )
    start = F.expr("struct(0.0D as carry, cast(array() as array<int>) as copies)")

    def diffuse(acc: Column, x: Column) -> Column:
        want = acc["carry"] + x["rate"] * x["size"]
        c = F.when(x["size"] == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(cap), F.round(want / x["size"]).cast("int"))))
        return F.struct((want - c * x["size"]).cast("double").alias("carry"), F.concat(acc["copies"], F.array(c.cast("int"))).alias("copies"))

    grouped = grouped.withColumn("copies", F.aggregate("items", start, diffuse)["copies"])
    out = grouped.select("source_size", "target", F.explode(F.arrays_zip("items", "copies")).alias("x"))
    return out.select(
        F.col("x.items.doc_id").alias("doc_id"),
        F.col("x.items.carried").alias("carried"),
        F.col("x.items.size").alias("size"),
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        F.col("x.items.rate").alias("rate"),
        F.col("x.copies").cast("int").alias("copies"),
        (F.col("x.copies") * F.col("x.items.size")).cast("long").alias("taken"),
    )


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", scratch: Scratch | None = None, **how) -> DataFrame:
    """The mix itself: docs with each row as often as mix() takes it, with the columns of docs. Of rows that are equal in
    id, text and source one stands for all, with their copies."""
    scratch = scratch or Scratch(docs.sparkSession, "mixture")
    mark = F.xxhash64(F.col(doc_id), F.col(text), F.col(source))
    taken = mix(docs, doc_id=doc_id, text=text, source=source, carry=mark, scratch=scratch, **how)
    # a row is known by its id and this hash; rows that share both are told apart by their values once more
    keys = taken.groupBy("doc_id", "carried").agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__rows"))
    keys = keys.where("__copies > 0").select(F.col("doc_id").alias("__id"), F.col("carried").alias("__mark"), "__copies", "__rows")
    keys = scratch.keep(keys, "copies")
    own = docs.withColumn("__own", mark)
    found = own.join(keys.hint("shuffle_hash"), (F.col("__own") == F.col("__mark")) & own[doc_id].eqNullSafe(keys["__id"])).drop("__own", "__id")
    single, more = found.where("__rows = 1"), found.where("__rows > 1").dropDuplicates(["__mark", doc_id, text, source])
    both = single.unionByName(more).drop("__mark", "__rows")
    return _repeated(both, "__copies", "__nth").drop("__copies", "__nth")
