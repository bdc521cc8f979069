"""Transitive closures and chained relations, as rounds of joins."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.storage import materialise


def transitive_closure(links: DataFrame, *, small_links: int = 500) -> DataFrame:
    """All (child, parent) reachable over links (child, parent), each once; cycles end by themselves.

    Null ends and loops to itself are left out. There is no bound on the depth. At
    most small_links links, as in a taxonomy, are walked in the driver, whose result
    is bounded by the square of that; more are joined in rounds on the executors.
    """
    links = links.where("child is not null and parent is not null and child <> parent").select("child", "parent").distinct()
    few = links.limit(small_links + 1).collect()
    if len(few) > small_links:
        return _closure_by_rounds(links)
    return links.sparkSession.createDataFrame(_reached([(r["child"], r["parent"]) for r in few]), links.schema)


def _reached(links: list[tuple]) -> list[tuple]:
    above = defaultdict(set)
    for child, parent in links:
        above[child].add(parent)
    pairs = []
    for child in list(above):
        seen, open_ends = {child}, [child]
        while open_ends:
            new = above.get(open_ends.pop(), set()) - seen
            seen |= new
            open_ends += new
        pairs += [(child, parent) for parent in seen - {child}]
    return pairs


def _closure_by_rounds(links: DataFrame) -> DataFrame:
    """Round k knows all pairs less than 2^k links apart and those exactly 2^k apart.

    A pair at a distance between them is one of the latter followed by one of the
    former, so each is met a few times at most and depth d takes log2(d) rounds. Each
    round is written down, so none is planned or computed again. Without a new pair in
    a round there is none further away.
    """
    known, size = materialise(links, "closure"), 0
    step = _composed(known, known)
    while (grown := known.count()) > size:
        size, step = grown, materialise(step, "closure-step")
        known = materialise(known.unionByName(step).unionByName(_composed(step, known)).distinct(), "closure")
        step = _composed(step, step)
    return known


def _composed(first: DataFrame, second: DataFrame) -> DataFrame:
    joined = first.alias("a").join(second.alias("b"), F.col("a.parent") == F.col("b.child"))
    return joined.select(F.col("a.child").alias("child"), F.col("b.parent").alias("parent")).where("child <> parent").distinct()


def closure_change(closure: DataFrame | None, links: DataFrame, *, added: DataFrame | None = None, removed: DataFrame | None = None, most_above: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(new, gone): the pairs (child, parent) by which the closure of links changes when links are added and removed.

    Without a closure at hand (None) none is made: each child's parents before and after
    are gathered and compared, see _changed_above. That is for changes all over the links;
    where a child has more than most_above parents, pairs are joined as below.

    closure is that of links, as transitive_closure gives it; a link in both added and
    removed stays or comes. What a removed link may have carried is suspected: pairs from
    below its child to above its parent. Suspects that the other links still carry come
    back, step by step from those whose next step is beyond suspicion; the rest is gone.
    An added link carries all from below its child to above its parent, and several of
    these follow each other. Only suspects and such pairs are joined and written, so the
    work follows the change; the closure is looked up, never made again.
    """
    if closure is None:
        changed = _changed_above(links, added, removed, most_above)
        if changed is not None:
            return tuple(changed.select("child", F.explode(kind).alias("parent")) for kind in ("new", "gone"))
        closure = transitive_closure(links)
    spark, schema = closure.sparkSession, closure.schema
    none = spark.createDataFrame([], schema)
    clean = lambda df: none if df is None else df.where("child is not null and parent is not null and child <> parent").select("child", "parent").distinct()
    coming = materialise(clean(added), "added")
    going = materialise(clean(removed).join(coming, ["child", "parent"], "left_anti").join(clean(links), ["child", "parent"], "left_semi"), "removed")
    kept = clean(links).join(going, ["child", "parent"], "left_anti")
    suspects = materialise(_carried(going, closure), "suspects")
    gone = none
    if not suspects.isEmpty():
        sure = closure.join(suspects, ["child", "parent"], "left_anti")
        steps = materialise(kept.alias("k").join(suspects.select("child").distinct(), "child", "left_semi"), "steps")  # links that lead on from suspects
        onward = materialise(suspects.select("child", F.col("parent").alias("end")).join(steps, "child").select("child", F.col("parent").alias("via"), "end"), "onward")
        beyond = sure.select(F.col("child").alias("via"), F.col("parent").alias("end"))
        back = onward.where("via = end").select("child", "end").unionByName(onward.join(beyond, ["via", "end"], "left_semi").select("child", "end")).distinct()
        back = fresh = materialise(back, "back")
        while not fresh.isEmpty():
            reached = onward.join(fresh.select(F.col("child").alias("via"), "end"), ["via", "end"], "left_semi").select("child", "end").distinct()
            fresh = materialise(reached.join(back, ["child", "end"], "left_anti"), "fresh")
            back = materialise(back.unionByName(fresh), "back")
        gone = materialise(suspects.join(back.withColumnRenamed("end", "parent"), ["child", "parent"], "left_anti"), "gone")
    left = closure.join(gone, ["child", "parent"], "left_anti")
    carried = materialise(_carried(coming, left), "carried")
    new = none if carried.isEmpty() else materialise(_closure_by_rounds(carried).join(left, ["child", "parent"], "left_anti"), "new")
    # what goes and comes back by way of another link has not changed
    return new.join(gone, ["child", "parent"], "left_anti"), gone.join(new, ["child", "parent"], "left_anti")


def _changed_above(links: DataFrame, added: DataFrame | None, removed: DataFrame | None, most_above: int) -> DataFrame | None:
    """child, new, gone: of each child whose parents at any distance change, those that come and go; None if a child has more than most_above.

    A row is a node: was and will, what is up to k links above it before and after, and
    ends, the nodes at the end of walks of k links. Going up, k doubles, but only for
    nodes that are ends themselves: in a taxonomy half of the nodes have nobody below,
    and few have many generations. Going back down, a node takes over all that is above
    its ends. So all that is above a node is shuffled where it has nodes below, and a
    second time where several ends meet. A node whose walks find nothing more has no ends,
    so cycles end by themselves.
    """
    clean = lambda df, kind: df.where("child is not null and parent is not null and child <> parent").select("child", "parent", F.lit(kind).alias("kind"))
    every = clean(links, "own")
    for df, kind in ((added, "added"), (removed, "removed")):
        every = every if df is None else every.unionByName(clean(df, kind))
    if not every.groupBy("child").count().where(F.col("count") > most_above).isEmpty():
        return None
    kinds = every.repartition("child").groupBy("child", "parent").agg(*(F.bool_or(F.col("kind") == kind).alias(kind) for kind in ("own", "added", "removed")))
    link = kinds.select("child", "parent", F.col("own").alias("was"), F.expr("added or own and not removed").alias("will")).where("was or will")
    ends = F.collect_list(F.struct(F.col("parent").alias("end"), "was", "will"))
    level = materialise(link.groupBy(F.col("child").alias("node")).agg(*(F.collect_list(F.when(F.col(kind), F.col("parent"))).alias(kind) for kind in ("was", "will")), ends.alias("ends")), "links-up")
    levels = []
    while True:
        upper = materialise(level.join(level.select(F.explode("ends.end").alias("node")).distinct(), "node", "left_semi"), "upper")
        if upper.isEmpty():
            break
        levels.append(level)
        level = materialise(_lifted(upper, upper), "level")
        if _more_than(level, most_above):
            return None
    while levels:
        level = _lifted(levels.pop(), level)
        if levels:
            level = materialise(level.select("node", "was", "will", "ends"), "above")
            if _more_than(level, most_above):
                return None
    at_all = lambda one, other: F.array_remove(F.array_except(one, other), F.col("node"))
    changed = level.select(F.col("node").alias("child"), at_all("will", "was").alias("new"), at_all("was", "will").alias("gone"))
    return materialise(changed.where("size(new) > 0 or size(gone) > 0"), "changed")


def _more_than(level: DataFrame, most: int) -> bool:
    return not level.where((F.size("was") > most) | (F.size("will") > most)).isEmpty()


def _lifted(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Nodes with what upper knows to be above their ends, and with the ends of these as ends, if that tells more."""
    above = upper.select(F.col("node").alias("_end"), F.col("was").alias("_was"), F.col("will").alias("_will"), F.col("ends").alias("_ends"))

    def met(own: DataFrame) -> DataFrame:
        each = own.select("node", "was", "will", F.explode_outer("ends").alias("e")).join(above, F.col("e.end") == F.col("_end"), "left")
        further = F.transform("_ends", lambda x: F.struct(x["end"].alias("end"), (x["was"] & F.col("e.was")).alias("was"), (x["will"] & F.col("e.will")).alias("will")))
        # without a flag, or without a node above, there is nothing: null
        return each.select("node", "was", "will", *(F.when(F.col(f"e.{kind}"), F.col(f"_{kind}")).alias(f"_{kind}") for kind in ("was", "will")), F.filter(further, lambda x: x["was"] | x["will"]).alias("_ends"))

    one = met(nodes.where("size(ends) <= 1"))
    one = one.select("node", "was", "will", *(F.coalesce(c, F.array().cast(upper.schema[c[1:]].dataType)).alias(c) for c in ("_was", "_will", "_ends")))
    several = met(nodes.where("size(ends) > 1")).groupBy("node").agg(*(F.first(c).alias(c) for c in ("was", "will")), *(F.flatten(F.collect_list(c)).alias(c) for c in ("_was", "_will", "_ends")))
    both = one.unionByName(several).withColumns({"_was": F.array_union("was", "_was"), "_will": F.array_union("will", "_will")})
    more = (F.size("_was") > F.size("was")) | (F.size("_will") > F.size("will"))
    return both.select("node", F.col("_was").alias("was"), F.col("_will").alias("will"), F.when(more, F.array_distinct("_ends")).otherwise(F.array().cast(upper.schema["ends"].dataType)).alias("ends"))


def _carried(links: DataFrame, closure: DataFrame) -> DataFrame:
    """Pairs from a link's child, or what is below it, to its parent, or what is above it."""
    below = links.unionByName(closure.select(F.col("child").alias("_x"), F.col("parent").alias("child")).join(links, "child").select(F.col("_x").alias("child"), "parent")).distinct()
    above = below.unionByName(below.join(closure.select(F.col("child").alias("parent"), F.col("parent").alias("_y")), "parent").select("child", F.col("_y").alias("parent")))
    return above.where("child <> parent").distinct()


def chained(first: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """The composition of two relations (a, by) and (by, c), each pair once."""
    return first.join(second, by).drop(by).distinct()


def typed(instances: DataFrame, subclasses: DataFrame) -> DataFrame:
    """id and class of instances, with every class above; subclasses has child and parent."""
    above = transitive_closure(subclasses)
    lifted = instances.join(above, F.col("class") == F.col("child")).select("id", F.col("parent").alias("class"))
    return instances.select("id", "class").unionByName(lifted).distinct()


def typed_by_relation(relation: DataFrame, subject: str, object_: str, domain: str | None, range_: str | None) -> DataFrame:
    """id and class that a relation's domain and range give to its two ends, each once; null ends have none."""
    ends = [relation.select(F.col(c).alias("id"), F.lit(kind).alias("class")) for c, kind in ((subject, domain), (object_, range_)) if kind is not None]
    found = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
    return found.where("id is not null").distinct()
