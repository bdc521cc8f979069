"""Operators over ordered rows: filling, runs, sampling, interleaving, thresholds, budgets.

Each keeps the columns it is given and states its tie-break; none needs rows in one
task beyond those of a partition key that the caller chooses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.storage import materialise

Keys = Sequence[str]


def forward_fill(df: DataFrame, column: str, partition: Keys, order: Keys, *, into: str, carry: Sequence[str] = ()) -> DataFrame:
    """into: the last value that is not null so far. Columns in carry keep the values of the row that column came from, even if null."""
    so_far = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    source = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), *carry))
    df = df.withColumn("_source", F.last(source, ignorenulls=True).over(so_far)).withColumn(into, F.col("_source.v"))
    for c in carry:
        df = df.withColumn(c, F.when(F.col("_source").isNull(), F.col(c)).otherwise(F.col(f"_source.{c}")))
    return df.drop("_source")


def longest_island(df: DataFrame, partition: Keys, index: str, weight: Column) -> DataFrame:
    """The run of consecutive indexes with the largest total weight of each partition; of equal ones the first."""
    by_index = Window.partitionBy(*partition).orderBy(index)
    runs = df.withColumn("_run", F.col(index) - F.row_number().over(by_index))
    totals = runs.groupBy(*partition, "_run").agg(F.sum(weight).alias("_total"), F.min(index).alias("_first"))
    best = totals.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc("_total"), "_first"))).where("_rank = 1")
    return runs.join(best.select(*partition, "_run"), [*partition, "_run"], "left_semi").drop("_run")


def first_seen(df: DataFrame, key: Keys, order: Keys) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def even_sample(df: DataFrame, partition: Keys, order: Keys, k: int, *, coarse: str | None = None) -> DataFrame:
    """k rows spread evenly from first to last of each partition: rank round(i * (n - 1) / (k - 1)), halves to even.

    A partition that is too large for one task is ranked by way of coarse, a column of
    few values that comes first in the order, such as a date: rows are ranked within
    its values, and only their counts are added up.
    """
    if coarse is None:
        ordered = Window.partitionBy(*partition).orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(ordered) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*partition)))
    else:
        keys = [*partition, coarse]
        by_value = Window.partitionBy(*(f"_{c}" for c in partition)).orderBy(f"_{coarse}")
        counts = df.groupBy(*(F.col(c).alias(f"_{c}") for c in keys)).agg(F.count("*").alias("_m"))
        counts = counts.withColumn("_before", F.sum("_m").over(by_value.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).withColumn("_n", F.sum("_m").over(Window.partitionBy(*(f"_{c}" for c in partition))))
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        within = Window.partitionBy(*keys).orderBy(*order)
        columns = df.columns
        df = df.join(counts, same).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1).select(*columns, "_rank", "_n")
    if k == 1:
        return df.where("_rank = 0").drop("_rank", "_n")
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(k - 1)).cast("long"))
    return df.where((F.col("_n") <= k) | F.array_contains(steps, F.col("_rank").cast("long"))).drop("_rank", "_n")


def newest(df: DataFrame, partition: Keys, order: Sequence[Column | str], k: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def round_robin(df: DataFrame, lists: str, order: Sequence[Column | str], k: int, *, into: str = "turn") -> DataFrame:
    """The first k of all lists, taken in turns; into is the place. Lists go by their own value within a turn."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(lists).orderBy(*order))).where(F.col("_rank") <= k)
    top = ranked.orderBy("_rank", lists).limit(k)
    return top.withColumn(into, F.row_number().over(Window.orderBy("_rank", lists))).drop("_rank")  # k rows at most


def temporal_diversity(df: DataFrame, period: str, score: str, tie: str, *, share: float = 0.9, limit: int = 15) -> DataFrame:
    """The best of each period, and others that reach share of it; the best of all of these."""
    best = df.groupBy(F.col(period).alias("_period")).agg(F.max(score).alias("_best"))
    met = df.join(best, F.col(period).eqNullSafe(F.col("_period"))).where(F.col(score) >= share * F.col("_best"))
    return met.drop("_period", "_best").orderBy(F.desc(score), tie).limit(limit)


def relative_threshold(df: DataFrame, score: str, *, share: float = 0.4, least: float = 4.0, override: Column | None = None) -> DataFrame:
    """Rows that reach share of the best score and least, or for which override holds."""
    top = df.agg(F.max(score).alias("_top"))  # one row
    kept = (F.col(score) >= share * F.col("_top")) & (F.col(score) >= least)
    return df.join(F.broadcast(top)).where(kept | override if override is not None else kept).drop("_top")


def body_rows(df: DataFrame, partition: Keys, order: str, length: str, *, most: int = 8) -> DataFrame:
    """The longest row of each partition's body: without the first and the last two, at most so many; all if nothing would be left."""
    key = Window.partitionBy(*partition)
    df = df.withColumn("_at", F.row_number().over(key.orderBy(order))).withColumn("_n", F.count("*").over(key))
    body = F.when(F.col("_n") > 3, (F.col("_at") > 1) & (F.col("_at") <= F.col("_n") - 2)).otherwise(F.lit(True))
    first = F.when(F.col("_n") > 3, F.col("_at") <= most + 1).otherwise(F.col("_at") <= most)
    return first_seen(df.where(body & first), partition, [F.desc(length), order]).drop("_at", "_n")


def filter_unless_few(df: DataFrame, predicate: Column, least: int) -> DataFrame:
    """Rows that meet the predicate, or all if fewer than least do."""
    met = df.agg(F.count_if(predicate).alias("_met"))  # one row
    return df.join(F.broadcast(met)).where(predicate | (F.col("_met") < least)).drop("_met")


def char_budget(df: DataFrame, partition: Keys, order: Sequence[Column | str], length: Column, budget: int) -> DataFrame:
    """Rows of each partition in order while their lengths add up to the budget; at least one."""
    ordered = Window.partitionBy(*partition).orderBy(*order)
    df = df.withColumn("_sum", F.sum(length).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(ordered))
    return df.where((F.col("_sum") <= budget) | (F.col("_rank") == 1)).drop("_sum", "_rank")


def common_cap(df: DataFrame, partition: Keys, length: str, budget: int, low: int, high: int) -> DataFrame:
    """The largest cap from low to high at which the capped lengths of each partition fit the budget; low if none does.

    Lengths are sorted once; between two of them the capped sum grows linearly in the
    cap, so the cap follows by division, without trying each.
    """
    key = Window.partitionBy(*partition)
    ordered = key.orderBy(length).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_below", F.coalesce(F.sum(length).over(ordered), F.lit(0))).withColumn("_rest", F.count("*").over(key) - F.row_number().over(key.orderBy(length)) + 1)
    fits = F.floor((F.lit(budget) - F.col("_below")) / F.col("_rest"))  # the cap if this row and all longer ones are capped
    # the first row that has to be capped decides; for those after it the same division gives less
    part = rows.groupBy(*partition).agg(F.max(F.when(fits < F.col(length), fits)).alias("cap"))
    return part.select(*partition, F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce("cap", F.lit(high)))).cast("long").alias("cap"))


def rarest(df: DataFrame, items: str, owner: str, *, most_share: float, per_owner: int, most_common_items: int = 200_000) -> DataFrame:
    """owner, item, df: of each owner the rarest of its items (an array of distinct ones) that at most most_share of all owners have.

    Owners are unique and few of their items are common, so the arrays are written down
    once: counting, and looking the counts up, read them and not the texts they are from.
    The most_common_items most common items go to the tasks with their counts, those that
    too many owners have among them, as long as these are no more. All other items are
    rarer, so an owner's items that are known to come after per_owner others leave before
    anything is shuffled.
    """
    held = materialise(df.select(owner, F.col(items).alias("_items")), "items")
    most = most_share * held.where(F.size("_items") > 0).count()
    counts = materialise(held.select(F.explode("_items").alias("item")).groupBy("item").agg(F.count("*").alias("df")), "counts")
    pairs = held.select(owner, F.explode("_items").alias("item"))
    octaves = counts.groupBy(F.floor(F.log2(F.col("df") + 0.5)).cast("int").alias("octave"), (F.col("df") > most).alias("common")).agg(F.count("*").alias("n")).collect()  # some sixty rows
    if sum(r["n"] for r in octaves if r["common"]) <= most_common_items:
        least = next(k for k in range(65) if sum(r["n"] for r in octaves if r["common"] or r["octave"] >= k) <= most_common_items)
        known = counts.where((F.col("df") > most) | (F.col("df") >= F.lit(2.0**least))).withColumnRenamed("df", "_df")
        place = [F.coalesce("_df", F.lit(0)), F.when(F.col("_df").isNotNull(), F.length("item")).desc(), F.when(F.col("_df").isNotNull(), F.col("item"))]
        met = pairs.join(F.broadcast(known), "item", "left").where(F.col("_df").isNull() | (F.col("_df") <= most))
        pairs = met.withColumn("_rank", F.rank().over(Window.partitionBy(owner).orderBy(*place))).where(F.col("_rank") <= per_owner).select(owner, "item")
    counts = counts.where(F.col("df") <= most)
    return newest(pairs.join(counts, "item"), [owner], ["df", F.desc(F.length("item")), "item"], per_owner)
