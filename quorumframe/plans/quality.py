"""Constraints on the typed tables: what breaks them, as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """key and rule for each row and rule that does not hold; a rule that gives null holds. One pass for all rules."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def dangling(df: DataFrame, column: str, referred: DataFrame, key: str) -> DataFrame:
    """Rows whose reference leads nowhere; null references are none."""
    return df.where(F.col(column).isNotNull()).join(referred.select(F.col(key).alias("_key")).distinct(), F.col(column) == F.col("_key"), "left_anti")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
