"""Joins on time and order: as-of, interval, nearest; and joins that must be unambiguous.

As-of joins merge both sides into one ordered stream per key, so they shuffle each
side once and never multiply rows. Interval joins cut intervals into buckets and
meet on bucket equality, so a long table of intervals needs no nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.functions.text import folded


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the last row of right whose at is not after its own; null if none is.

    Of rows of right at one place the one with the largest values counts. Rows of a key
    meet in one task; ordered.asof is for keys that are too large for that, or none.
    """
    columns = left.columns
    one = left.select(*keys, at, F.struct(*columns).alias("_row"), F.lit(None).cast(_struct(right, values)).alias("_value"), F.lit(1).alias("_side"))
    two = right.select(*keys, at, F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_value"), F.lit(0).alias("_side"))
    order = Window.partitionBy(*keys).orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    met = one.unionByName(two).withColumn("_value", F.last("_value", ignorenulls=True).over(order)).where("_side = 1")
    return met.select(*(F.col(f"_row.{c}") for c in columns), *(F.col(f"_value.{v}") for v in values))


def _struct(df: DataFrame, values: Sequence[str]):
    return df.select(F.struct(*values).alias("v")).schema["v"].dataType


def holds(at: Column | str, start: Column | str, end: Column | str, *, closed: bool = True) -> Column:
    """Whether an interval, closed or open at its end, holds a date; a null start or end is open. Null for a null date."""
    at, start, end = (F.col(c) if isinstance(c, str) else c for c in (at, start, end))
    return (start.isNull() | (start <= at)) & (end.isNull() | ((at <= end) if closed else (at < end))) & at.isNotNull()


def interval_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, *, bucket_days: int = 365, closed: bool = True, on: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows of left with the intervals of right that hold their date; closed, or open at the end.

    A null start or end is open, and intervals that end before they start hold nothing.
    Intervals are cut into buckets from the first to the last date that left asks for, so
    an open or very long one has no more of them than others.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(bucket_days))
    asked = left.agg(F.min(at).alias("_from"), F.max(at).alias("_to"))  # one row
    ends = [F.greatest(F.coalesce(start, "_from"), F.col("_from")), F.least(F.coalesce(end, "_to"), F.col("_to"))]
    meant = F.coalesce(F.col(start) <= F.col(end), F.lit(True)) & (ends[0] <= ends[1])
    cut = right.join(F.broadcast(asked)).where(meant).withColumn("_bucket", F.explode(F.sequence(bucket(ends[0]), bucket(ends[1])))).drop("_from", "_to")
    met = (bucket(F.col(at)) == F.col("_bucket")) & holds(at, start, end, closed=closed)
    return left.join(cut, met & on if on is not None else met, how).drop("_bucket")


def nearest_before_after(dates: DataFrame, wanted: DataFrame, at: str, other: str) -> DataFrame:
    """wanted (at) with the last date other before and the first after, by two as-of passes over one sorted union."""
    both = wanted.select(F.col(at).alias("d"), F.lit(1).alias("side")).distinct().unionByName(dates.select(F.col(other).alias("d"), F.lit(0).alias("side")).distinct())
    known = F.when(F.col("side") == 0, F.col("d"))
    # strictly before and after: ranges end a day off
    order = Window.orderBy(F.unix_date("d"))  # distinct dates: a small dimension
    spread = both.withColumn("before", F.max(known).over(order.rangeBetween(Window.unboundedPreceding, -1))).withColumn("after", F.min(known).over(order.rangeBetween(1, Window.unboundedFollowing)))
    return spread.where("side = 1").select(F.col("d").alias(at), "before", "after")


def unambiguous(matches: DataFrame, key: Sequence[str], candidate: str) -> DataFrame:
    """key and candidate where exactly one distinct candidate matches; null where several do."""
    one = matches.groupBy(*key).agg(F.count_distinct(candidate).alias("_n"), F.min(candidate).alias("_one"))
    return one.select(*key, F.when(F.col("_n") == 1, F.col("_one")).alias(candidate))


def active_counts(dates: DataFrame, intervals: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Each distinct date of dates with n, how many closed intervals hold it; n is never zero, other dates go.

    Intervals that began by a date less those that ended before it: both are counted by
    day first, so no pair of a date and an interval is ever made. A null start or end is open.
    """
    meant = intervals.where(F.coalesce(F.col(start) <= F.col(end), F.lit(True)))
    begun = meant.groupBy(F.coalesce(start, F.to_date(F.lit("0001-01-01"))).alias("_d")).agg(F.count("*").alias("_n"))
    ended = meant.where(F.col(end).isNotNull()).groupBy(F.date_add(end, 1).alias("_d")).agg((-F.count("*")).alias("_n"))
    asked = dates.select(F.col(at).alias("_d"), F.lit(0).cast("long").alias("_n")).where("_d is not null").distinct().withColumn("_asked", F.lit(True))
    steps = begun.unionByName(ended).withColumn("_asked", F.lit(False)).unionByName(asked)
    by_day = Window.orderBy("_d").rangeBetween(Window.unboundedPreceding, 0)  # three rows a day of the calendar at most
    return steps.withColumn("n", F.sum("_n").over(by_day)).where("_asked and n > 0").select(F.col("_d").alias(at), "n")


def named_at(asked: DataFrame, people: DataFrame, name: str, at: str, person: str, start: str, end: str, *, hint: str | None = None) -> DataFrame:
    """asked, distinct, with the one person a name means at a date, and null where it is not one.

    People of that name who are active then come before those who are not; where nobody
    is active all of that name are meant. With hint, a column of both tables, people
    whose hint agrees come before the others within that choice, and where none agrees
    or the hint is null it says nothing. Names that nobody has go. Who has no end is
    still active, who has no start always was.

    No pair of a date and a person is ever made: starts, dates and ends are one ordered
    stream per name (and hint), in which those active are counted and their numbers
    added up, so that the number of one who is active alone is that sum. Rows without a
    person name nobody.
    """
    keys = [name, at, *([hint] if hint else [])]
    own = people.where(F.col(name).isNotNull() & F.col(person).isNotNull()).select(F.col(name), F.col(person).alias("_person"), F.col(start).alias("_start"), F.col(end).alias("_end"), *([F.col(hint).alias("_hint")] if hint else []))
    numbers = own.select(name, "_person").distinct().withColumn("_number", F.row_number().over(Window.partitionBy(name).orderBy("_person")).cast("long"))
    own = own.join(numbers, [name, "_person"])
    said = asked.select(*keys, *([F.col(hint).alias("_hint")] if hint else [])).where(F.col(name).isNotNull()).distinct()
    told = said.join(_held(own, [name], "_all"), name)
    told = told.join(_active(own, said, [name], at, "_now"), [name, at], "left")
    order = ["_now", "_all"]
    if hint:  # a null date or hint meets nothing here, as it says nothing
        told = told.join(_held(own, [name, "_hint"], "_all_hinted"), [name, "_hint"], "left").join(_active(own, said, [name, "_hint"], at, "_now_hinted"), [name, "_hint", at], "left")
        order = ["_now_hinted", "_now", "_all_hinted", "_all"]
    best = F.coalesce(*(F.when(F.col(f"{c}.n") > 0, F.col(c)) for c in order))
    met = told.select(*keys, best.alias("_best")).select(*keys, F.when(F.col("_best.n") == 1, F.col("_best.number")).alias("_number"))
    return met.join(numbers, [name, "_number"], "left").select(*keys, F.col("_person").alias(person))


def _held(own: DataFrame, by: list[str], told: str) -> DataFrame:
    """For each name (and hint) how many people have it, and the sum of their numbers."""
    each = own.select(*by, "_number").distinct().groupBy(*by)
    return each.agg(F.struct(F.count("*").alias("n"), F.sum("_number").alias("number")).alias(told))


def _active(own: DataFrame, asked: DataFrame, by: list[str], at: str, told: str) -> DataFrame:
    """The same for those active at each date asked for: who began by it and did not end before it."""
    meant = own.where(F.coalesce(F.col("_start") <= F.col("_end"), F.lit(True)))
    step = lambda rows, place, side, n: rows.select(*by, "_number", F.col(place).alias(at), F.lit(side).alias("_side"), F.lit(n).cast("long").alias("_n"))
    ends = step(meant, "_start", 0, 1).unionByName(step(meant.where("_end is not null"), "_end", 2, -1))  # at one date first who begins, then who is asked for, then who ends
    # intervals of one person may overlap: only where the first begins and the last ends
    depth = F.sum("_n").over(Window.partitionBy(*by, "_number").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    outer = ends.withColumn("_depth", depth).where("(_n = 1 and _depth = 1) or _depth = 0").drop("_depth")
    dates = asked.where(F.col(at).isNotNull()).select(*by, at).distinct().select(*by, F.lit(0).cast("long").alias("_number"), at, F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_n"))
    order = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.struct(F.sum("_n").over(order).alias("n"), F.sum(F.col("_n") * F.col("_number")).over(order).alias("number"))
    return outer.unionByName(dates).withColumn(told, counted).where("_side = 1").select(*by, at, told)


def resume(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of source that are not done yet; null keys were never done."""
    return source.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def dated_key(date: Column | str, title: Column | str, most: int = 80) -> Column:
    """A key of a date label and the beginning of a folded title."""
    date = F.col(date) if isinstance(date, str) else date
    return F.concat_ws("||", date, F.substring(folded(title), 1, most))


def with_ids(rows: DataFrame, ids: DataFrame, keys: Sequence[str], own: str, id_: str) -> DataFrame:
    """rows with their own id, else the one that ids has for their keys, each once; null if there is none."""
    return rows.join(ids, list(keys), "left").withColumn(id_, F.coalesce(own, id_)).drop(own)


def patched(df: DataFrame, patches: DataFrame, key: str, order: str) -> DataFrame:
    """df with the values of the last patch of its key; a patch holds all its columns, null deletes."""
    columns = [c for c in patches.columns if c not in (key, order)]
    last = patches.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_patch"))
    met = df.join(last, key, "left")
    return met.select(*(F.when(F.col("_patch").isNotNull(), F.col(f"_patch.{c}")).otherwise(F.col(c) if c in df.columns else F.lit(None)).alias(c) if c in columns else F.col(c) for c in dict.fromkeys([*df.columns, *columns])))
