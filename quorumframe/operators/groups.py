"""Aggregations with a rule of their own: majorities, decisive rows, modes, fused rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, keys: Sequence[str], choice: str, share: float = 0.75) -> DataFrame:
    """keys and choice where at least share of the rows that choose agree."""
    counts = df.where(F.col(choice).isNotNull()).groupBy(*keys, choice).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    return counts.withColumn("_all", total).where(F.col("_n") >= share * F.col("_all")).drop("_n", "_all")


def decisive(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """df with is_decisive: whether the row is the last of its keys."""
    return df.withColumn("is_decisive", F.col(order) == F.max(order).over(Window.partitionBy(*keys)))


def most_common(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equal ones the first seen."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = F.min_by(value, F.struct(-F.col("_n"), F.col("_first"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias(value))


def active_intervals(activities: Sequence[DataFrame], key: str, at: str) -> DataFrame:
    """First and last date of each key over several tables of (key, at), each combined before the union."""
    parts = [a.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")) for a in activities]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(key).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def fused(df: DataFrame, key: str, columns: Sequence[str], separator: str = "; ") -> DataFrame:
    """One row for each key; distinct values of each column in order, joined."""
    return df.groupBy(key).agg(*(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), separator).alias(c) for c in columns))


def joined_text(df: DataFrame, key: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """Texts of each key in order, joined."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), separator).alias(text))


def without_translated_copies(df: DataFrame, keys: Sequence[str], language: str, preferred: str) -> DataFrame:
    """df without rows in other languages where one in the preferred language has the same keys; null keys are one group."""
    has = F.max((F.col(language) == preferred).cast("int")).over(Window.partitionBy(*keys))
    return df.withColumn("_has", has).where((F.col(language) == preferred) | (F.coalesce("_has", F.lit(0)) == 0)).drop("_has")


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))


def verdicts(df: DataFrame, keys: Sequence[str], verdict: str, values: Sequence[str], latency: str) -> DataFrame:
    """Share of each verdict and mean latency by keys; the values are given, so no pass finds them."""
    rates = [F.avg((F.col(verdict) == v).cast("double")).alias(f"share_{v}") for v in values]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *rates, F.avg(latency).alias("mean_latency"))


def last_known(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """keys with the last value of each column that is not null, in order."""
    return df.groupBy(*keys).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values))


def first_known(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """keys with the first value of each column that is not null, in order."""
    return df.groupBy(*keys).agg(*(F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values))


def fullest(df: DataFrame, keys: Sequence[str], values: Sequence[str], tie: str) -> DataFrame:
    """Of each key the row with the most values that are not null; of equal ones the first by tie."""
    known = sum((F.col(v).isNotNull().cast("int") for v in values), F.lit(0))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-known, F.col(tie))).alias("_row")).select(*keys, "_row.*")


def solved_by_majority(runs: DataFrame, keys: Sequence[str], shape: str, question: str, ok: str) -> DataFrame:
    """keys, shape, n and solved: how many questions of each shape there are, and how many most of their repetitions solve."""
    each = runs.groupBy(*keys, shape, question).agg(F.avg(F.col(ok).cast("double")).alias("_share"))
    return each.groupBy(*keys, shape).agg(F.count("*").alias("n"), F.count_if(F.col("_share") > 0.5).alias("solved"))


def never_solved(runs: DataFrame, question: str, ok: str) -> DataFrame:
    """Questions that no run solves."""
    return runs.groupBy(question).agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("_any")).where("not _any").select(question)
