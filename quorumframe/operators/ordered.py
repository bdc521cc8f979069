"""Ordered computations that no key has to fit a task for: running totals, last known values, previous rows, runs, as-of joins.

A window with a partition key puts all rows of a key into one task, which a key with a
third of all rows, or no key at all, does not allow. Here rows are sorted by range of
(keys, order), so a large key lies in several parts. Then

1. a table of at most two rows a part says what each key that goes on from part to part
   adds to those after it;
2. a running pass over that small table gives what a key brings into each part;
3. each part computes on its own and adds what came in.

Rows move twice, whatever the key. For keys that are known to be small a plain window
moves them once and is to be preferred.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.storage import materialise

Order = Sequence[Column | str]


def over_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    *,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """df with new columns over the order of each key: last (the last value so far that is not null), total (the sum so far, nulls as zero) and previous (the value of the row before, null for the first).

    The row itself counts for last and total. Null keys are a key, and without keys all
    rows are one order. Rows that the order does not tell apart come in any order, so let
    it be total. parts is the number of ranges, by default that of shuffle partitions.
    """
    last, total, previous = dict(last or {}), dict(total or {}), dict(previous or {})
    columns = df.columns
    made = {f"_last_{c}": F.when(v.isNotNull(), F.struct(v.alias("v"))) for c, v in last.items()}
    made |= {f"_total_{c}": v for c, v in total.items()} | {f"_previous_{c}": F.struct(v.alias("v")) for c, v in previous.items()}
    placed = df.withColumns(made | {"_key": F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))})
    by = [*keys, *order]
    ranged = placed.repartitionByRange(parts, *by) if parts else placed.repartitionByRange(*by)
    rows = materialise(ranged.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))

    edges = rows.groupBy("_part").agg(F.min("_key").alias("first"), F.max("_key").alias("end"))
    going = edges.select("_part", F.explode(F.array("first", "end")).alias("_key")).distinct().groupBy("_key").count().where("count > 1").select("_key")
    ends = [F.max_by(f"_last_{c}", F.when(F.col(f"_last_{c}").isNotNull(), F.col("_at"))).alias(f"_last_{c}") for c in last]
    ends += [F.sum(f"_total_{c}").alias(f"_total_{c}") for c in total]
    ends += [F.max_by(f"_previous_{c}", "_at").alias(f"_previous_{c}") for c in previous]
    of_part = rows.join(F.broadcast(going), "_key").groupBy("_key", "_part").agg(*ends)
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    brought = [F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_in_last_{c}") for c in last]
    brought += [F.sum(f"_total_{c}").over(before).alias(f"_in_total_{c}") for c in total]
    brought += [F.last(f"_previous_{c}").over(before).alias(f"_in_previous_{c}") for c in previous]
    carried = of_part.select("_key", "_part", *brought)  # two rows a part at most

    met = rows.join(F.broadcast(carried), ["_key", "_part"], "left")
    within = Window.partitionBy("_part", "_key").orderBy("_at")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    new = [F.coalesce(F.last(f"_last_{c}", ignorenulls=True).over(so_far), F.col(f"_in_last_{c}"))["v"].alias(c) for c in last]
    new += [(F.coalesce(F.sum(f"_total_{c}").over(so_far), F.lit(0)) + F.coalesce(F.col(f"_in_total_{c}"), F.lit(0))).alias(c) for c in total]
    new += [F.coalesce(F.lag(f"_previous_{c}").over(within), F.col(f"_in_previous_{c}"))["v"].alias(c) for c in previous]
    return met.select(*(c for c in columns if c not in {*last, *total, *previous}), *new)


def filled_forward(df: DataFrame, column: str, keys: Sequence[str], order: Order, *, into: str, carry: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """As windows.forward_fill: into is the last value so far; columns in carry keep the values of the row it came from, even if null."""
    source = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), *carry))
    met = over_order(df, keys, order, last={"_source": source}, parts=parts).withColumn(into, F.col("_source.v"))
    for c in carry:
        met = met.withColumn(c, F.when(F.col("_source").isNull(), F.col(c)).otherwise(F.col(f"_source.{c}")))
    return met.drop("_source")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], *, parts: int | None = None) -> DataFrame:
    """As joins.asof_join: left with the values of the last row of right whose at is not after its own; of several at one place the largest values."""
    value = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    one = left.select(*keys, at, F.struct(*left.columns).alias("_row"), F.lit(None).cast(value).alias("_value"), F.lit(1).alias("_side"))
    two = right.select(*keys, at, F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_value"), F.lit(0).alias("_side"))
    met = over_order(one.unionByName(two), keys, [at, "_side", "_value"], last={"_met": F.col("_value")}, parts=parts).where("_side = 1")
    return met.select(*(F.col(f"_row.{c}") for c in left.columns), *(F.col(f"_met.{v}") for v in values))


def runs(df: DataFrame, keys: Sequence[str], index: str, *, into: str = "run", parts: int | None = None) -> DataFrame:
    """df with into, the index at which the run of consecutive indexes begins that a row belongs to."""
    before = over_order(df, keys, [index], previous={"_before": F.col(index)}, parts=parts)
    begins = F.col("_before").isNull() | (F.col(index) != F.col("_before") + 1)
    return over_order(before, keys, [index], last={into: F.when(begins, F.col(index))}, parts=parts).drop("_before")


def longest_run(df: DataFrame, keys: Sequence[str], index: str, weight: Column, *, parts: int | None = None) -> DataFrame:
    """As windows.longest_island: the run of consecutive indexes with the largest total weight of each key; of equal ones the first."""
    marked = materialise(runs(df, keys, index, into="_run", parts=parts), "runs")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    totals = marked.groupBy(key.alias("_key"), "_run").agg(F.sum(weight).alias("_total"), F.max(index).alias("_end"))
    best = totals.groupBy("_key").agg(F.max_by(F.struct("_run", "_end"), F.struct("_total", -F.col("_run"))).alias("_best"))
    # the best run of a key is one range of its indexes: rows meet it by their key, and large keys are split by the join
    met = marked.withColumn("_key", key).join(best, "_key").where(F.col("_run") == F.col("_best._run"))
    return met.select(*df.columns)


def sessions(df: DataFrame, keys: Sequence[str], at: str, tie: str, gap_seconds: int, *, into: str = "session", parts: int | None = None) -> DataFrame:
    """df with into, the number (from 1) of the session of its key: a row after a gap of at least gap_seconds opens a new one."""
    before = over_order(df, keys, [at, tie], previous={"_before": F.col(at)}, parts=parts)
    opens = F.col("_before").isNull() | (F.col(at) >= F.col("_before") + F.make_dt_interval(secs=F.lit(gap_seconds)))
    return over_order(before, keys, [at, tie], total={into: opens.cast("long")}, parts=parts).drop("_before")
