"""A property graph as two tables: nodes (id, label, ...) and edges (src, dst, type). All steps are equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A text without digits, and a number of up to nine digits after it as it is written: the two give the whole again.
NUMBERED = r"\A([^0-9]*)(0|[1-9][0-9]{0,8})\z"


def mirrored(edges: DataFrame, back: dict[str, str]) -> DataFrame:
    """Edges with, for each type, the type of its mirror image, and those images."""
    names = F.create_map(*[F.lit(x) for kv in sorted(back.items()) for x in kv])
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.element_at(names, F.col("type")).alias("type"))
    return edges.select("src", "dst", "type").unionByName(turned)


def domain_label(labels: Column, base: str = "BaseEntity", last: bool = True) -> Column:
    """The last (or first) label that isn't the base one; the base label if there is no other."""
    own = F.filter(labels, lambda x: x != base)
    return F.coalesce(F.try_element_at(own, F.lit(-1 if last else 1)), F.lit(base))


def kept_fields(props: Column, label: Column, fields: dict[str, tuple[str, ...]]) -> Column:
    """Only the properties that a label shows; all of them for a label that isn't listed."""
    shown = F.create_map(*[x for k, v in sorted(fields.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    names = F.element_at(shown, label)
    return F.when(names.isNull(), props).otherwise(F.map_filter(props, lambda k, _: F.array_contains(names, k)))


def neighbours(roots: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, i, id, j, dst, type): outgoing edges of roots (by, i, id), numbered from 0 by (type, dst) within a root."""
    by = by or []
    found = roots.select(*by, "i", "id").join(edges, F.col("id") == F.col("src"))
    j = F.row_number().over(W.partitionBy(*by, "i").orderBy("type", "dst")) - 1
    return found.withColumn("j", j).select(*by, "i", "id", "j", "dst", "type")


def with_parts(found: DataFrame, whole: DataFrame, parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """found (by, i, id, j, dst, type) with each dst of `whole` (id) replaced in place by its parts (whole_id, ord, part_id) in
    order; one without parts goes. Adds `sub`, the order within a place."""
    marked = found.join(whole.select(F.col("id").alias("dst"), F.lit(True).alias("is_whole")).distinct(), "dst", "left")
    opened = marked.join(parts.select(F.col("whole_id").alias("dst"), "ord", "part_id"), "dst", "left")
    kept = opened.where("is_whole is null or part_id is not null")
    return kept.select(
        *(by or []), "i", "id", "j", F.coalesce(F.when(F.col("is_whole"), F.col("ord")), F.lit(0)).alias("sub"),
        F.when(F.col("is_whole"), F.col("part_id")).otherwise(F.col("dst")).alias("dst"), "type",
    )


def two_hops(roots: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, level, i, j, k, id, type): neighbours of roots (by, i, id), and their neighbours that were not met before.

    The first level keeps repetitions. A node enters the second level where it is met first, in the order of (i, j, k),
    unless it is a root or was met on the first level up to there. `by` holds sets of roots apart, as those of queries.
    """
    by = by or []
    one = neighbours(roots, edges, by).select(*by, "i", "j", "dst", "type")
    met = one.where("dst is not null").select(F.col("dst").alias("i"), F.col("dst").alias("id")).distinct()
    ahead = neighbours(met, edges).select("id", F.col("j").alias("k"), "dst", "type")
    return second_hop(roots, one, ahead, by)


def second_hop(roots: DataFrame, one: DataFrame, ahead: DataFrame, by: list[str], tasks: int | None = None) -> DataFrame:
    """(by, level, i, j, k, id, type): the first level `one` (by, i, j, dst, type), and what its nodes lead to by `ahead` (id, k,
    dst, type; k from 0, the same types together) where it is met first.

    What lies ahead travels as one list for each type of a node, once for each root set and node, and is opened where all rows
    of the root set are (in `tasks` tasks, so that each sorts few): the second level makes no other shuffle. Ends that are one
    word and a number each, as those of a kind of node often are, travel as numbers, which take a few bytes.
    """
    text = dict(ahead.dtypes)["dst"] == "string"
    head = F.regexp_extract("dst", NUMBERED, 1) if text else F.lit(None).cast("string")
    tail = F.when(F.col("dst").rlike(NUMBERED), F.regexp_extract("dst", NUMBERED, 2).cast("int")) if text else F.lit(None).cast("int")
    lists = ahead.withColumn("head", head).withColumn("tail", tail).groupBy("id", "type").agg(
        F.sort_array(F.collect_list(F.struct("k", "dst", "tail"))).alias("l"), F.min("head").alias("head"),
        ((F.min("head") == F.max("head")) & (F.count("tail") == F.count("*"))).alias("same"),
    )
    lists = lists.withColumn("same", F.coalesce("same", F.lit(False))).select(
        "id", "type", F.col("l")[0]["k"].alias("k"), F.when(~F.col("same"), F.transform("l", lambda x: x["dst"])).alias("ends"),
        F.when(F.col("same"), F.col("head")).alias("head"), F.when(F.col("same"), F.transform("l", lambda x: x["tail"])).alias("tails"),
    )
    # of a node that is met again all ends have been met before
    fan = one.where("dst is not null").groupBy(*by, F.col("dst").alias("id")).agg(F.min(F.struct("i", "j")).alias("m"))
    fan = fan.select(*by, "id", F.col("m.i").alias("i"), F.col("m.j").alias("j"))
    held = F.lit(True)
    for c in by:
        held = held & F.col(c).isNotNull()
    none = F.lit(None).cast(dict(one.dtypes)["type"]).alias("type")
    # marks: what is a root, or was met on the first level up to a place, comes before the second level's ends of it
    plain = [F.lit(None).cast("string").alias("head"), F.lit(None).cast("array<int>").alias("tails")]
    marks = roots.where(held & F.col("id").isNotNull()).select(*by, F.lit(0).alias("kind"), "i", F.lit(0).alias("j"), F.lit(-1).alias("k"), none, F.array("id").alias("ends"), *plain)
    firsts = one.where(held & F.col("dst").isNotNull()).select(*by, F.lit(1).alias("kind"), "i", "j", F.lit(-1).alias("k"), none, F.array("dst").alias("ends"), *plain)
    far = fan.join(lists, "id").select(*by, F.lit(1).alias("kind"), "i", "j", "k", "type", "ends", "head", "tails")
    every = far.unionByName(marks).unionByName(firsts)
    every = every.repartition(*([tasks] if tasks else []), *by) if by else every
    each = every.select(*by, "kind", "i", "j", "k", "type", "head", "ends", F.posexplode_outer("tails").alias("at", "tail"))
    each = each.select(*by, "kind", "i", "j", "k", "type", "head", "at", "tail", F.posexplode_outer("ends").alias("place", "dst"))
    # numbered ends are texts
    dst = F.coalesce("dst", F.concat("head", F.col("tail").cast("string"))) if text else F.col("dst")
    each = each.select(*by, "kind", "i", "j", "k", "type", F.coalesce("place", "at").alias("at"), dst.alias("dst"))
    each = each.withColumn("n", F.row_number().over(W.partitionBy(*by, "dst").orderBy("kind", "i", "j", "k", "at"))).where("n = 1 and k >= 0")
    a = one.select(*by, F.lit(1).alias("level"), "i", "j", F.lit(0).alias("k"), F.col("dst").alias("id"), "type")
    return a.unionByName(each.select(*by, F.lit(2).alias("level"), "i", "j", (F.col("k") + F.col("at")).alias("k"), F.col("dst").alias("id"), "type"))


def trails(starts: DataFrame, edges: DataFrame, ends: DataFrame, most: int = 2) -> DataFrame:
    """Distinct (start, end) that one to `most` edges connect without using an edge twice; edges that come twice are one.

    Trails meet their last edges, those into an end, where these lie, and beside them each end itself, at which a trail may
    have arrived an edge before: one join tells both lengths. Of `most` 2 only loops can be used twice, so only these are told."""
    mark = F.xxhash64("src", "dst", "type")
    edge = edges.select("src", "dst", (mark if most > 2 else F.when(F.col("src") == F.col("dst"), mark)).alias("edge"))
    goal = ends.select(F.col("id").alias("dst")).distinct()
    last = edge.join(goal, "dst", "left_semi").select("src", "dst", "edge")
    stay = goal.select(F.col("dst").alias("src"), "dst", F.lit(None).cast("bigint").alias("edge"))

    def step(now: DataFrame, by: DataFrame) -> DataFrame:
        met = now.join(by, F.col("at") == F.col("src"))
        return met.where(F.col("used").isNull() | F.col("edge").isNull() | ~F.array_contains("used", F.col("edge")))

    now = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.lit(None).cast("array<bigint>").alias("used"))
    out = None
    for n in range(most):
        if (most - n) % 2:  # tells trails of n edges, if there are any, and of one more
            hit = step(now, last.unionByName(stay) if n else last).select("start", F.col("dst").alias("end"))
            out = hit if out is None else out.unionByName(hit)
        used = F.array_append(F.coalesce("used", F.array().cast("array<bigint>")), F.col("edge"))
        now = step(now, edge).select("start", F.col("dst").alias("at"), F.when(F.col("edge").isNull(), F.col("used")).otherwise(used).alias("used"))
    return out.distinct()


def ordered_text(rows: DataFrame, by: list[str], order: str, text: str, between: str, name: str = "text") -> DataFrame:
    """Texts of each group joined in order, nulls of the order last; null texts count as empty."""
    item = F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), between).alias(name))


def requested(ids: DataFrame, nodes: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Details of requested ids (pos, id) in request order; for an id that isn't there the defaults stand."""
    found = ids.join(nodes.withColumn("found", F.lit(True)), "id", "left")
    for name, value in defaults.items():
        found = found.withColumn(name, F.when(F.col("found"), F.col(name)).otherwise(value))
    return found.withColumn("found", F.coalesce("found", F.lit(False))).orderBy("pos")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page with total, has_next and has_prev on each row."""
    if number < 1 or size < 1:
        raise ValueError("page and size start at 1")
    total = rows.agg(F.count("*").alias("total"))
    out = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    out = out.join(F.broadcast(total))  # one row
    return out.withColumn("has_next", F.col("total") > number * size).withColumn("has_prev", F.lit(number > 1))


def groups_in_order(rows: DataFrame, by: list[str], group: str, at: str, item: str) -> DataFrame:
    """(by, pos, group, items): the groups of each `by` in the order in which they are first met by `at` (ties by group, null
    first), pos from 1, with their distinct items in order. Rows without a group are a group of their own."""
    per = rows.groupBy(*by, group).agg(F.min(at).alias("__at"), F.sort_array(F.collect_set(item)).alias("items"))
    place = F.row_number().over(W.partitionBy(*by).orderBy("__at", F.asc_nulls_first(group)))
    return per.withColumn("pos", place).select(*by, "pos", group, "items")
