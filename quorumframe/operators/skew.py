"""Joins in which single keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if this share of all rows has it; so at most its inverse are.
HOT_SHARE = 0.001


def hot_join(rows: DataFrame, facts: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """rows with the facts of their key, where single keys may hold a third of all rows.

    facts has each key once and in n how many rows have it. Keys of more than
    HOT_SHARE of all rows are at most 1 / HOT_SHARE many, so their facts are
    broadcast and their rows stay where they are; only rows of other keys are
    shuffled. rows and facts are read twice: write them down first.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    most = max(10_000, int(HOT_SHARE * total))
    hot = facts.where(F.col(n) > most)
    if hot.isEmpty():
        return rows.join(facts.drop(n), key, how)
    at_once = rows.join(F.broadcast(hot.drop(n)), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(n) <= most).drop(n), key, how)
    return at_once.unionByName(others)


def hot_keys(rows: DataFrame, key: str, *, most: int = 1_000) -> DataFrame | None:
    """key and salts of each key with more than HOT_SHARE of all rows, and more than most; None if there is none.

    salts is over how many tasks its rows are to be dealt so that none gets much more than
    that share. rows are read twice: write them down first.
    """
    bound = max(most, int(HOT_SHARE * rows.count()))
    found = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > bound).select(key, F.ceil(F.col("n") / bound).cast("int").alias("salts"))
    known = found.collect()  # at most 1 / HOT_SHARE keys
    return rows.sparkSession.createDataFrame(known, found.schema) if known else None


def salted_join(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame | None, by: list[str]) -> DataFrame:
    """The inner join of rows and facts on key, for facts of hot keys that are too large or too many to broadcast.

    hot is what hot_keys gives for rows, or for the table they are derived from. Rows of a
    hot key are dealt by the columns in by, and its facts are repeated for each salt: a
    copy for each share of rows that they meet anyway.
    """
    if hot is None:
        return rows.join(facts, key)
    known = F.broadcast(hot.withColumnRenamed("salts", "_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(known, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_salts")
    copied = facts.join(known, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
