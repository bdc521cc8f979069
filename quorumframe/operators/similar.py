"""Names that differ in few letters, found without comparing all with all.

A string cut into e + 1 pieces keeps one of them whole under e edits, at a place that has
moved by no more than the edits before it, while those after it make up for the rest of
the difference in length. Pieces are as long as the string allows, so few strings meet.
Where a piece is so common that too many would, two are asked for: of e + 2 pieces two
stay whole. What meets is compared letter by letter.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumframe.operators.components import components
from quorumframe.storage import materialise


def _pieces(count: int, size: Column) -> list[tuple[Column, Column]]:
    """First place and length of each of so many pieces of a string of that size."""
    cuts = [F.floor(size * k / count).cast("int") for k in range(count + 1)]
    return [(a + 1, b - a) for a, b in zip(cuts, cuts[1:])]


def _shifts(held: int, edits: int) -> list[tuple[int, tuple[int, ...]]]:
    """By how much longer a string may be than another, and how far so many pieces may then have moved in it."""
    found = []
    for more in range(edits + 1):
        for moved in product(range(-edits, edits + 1), repeat=held):
            ends = (0, *moved, more)
            if sum(abs(b - a) for a, b in zip(ends, ends[1:])) <= edits:
                found.append((more, moved))
    return found


def _blocks(keys: DataFrame, edits: int, held: int) -> tuple[DataFrame, DataFrame]:
    """Strings by their own pieces (other, block), and by what may be pieces of one that is as long or shorter (one, block).

    held is how many pieces, of edits + held, a block has.
    """
    count = edits + held

    def block(size, which, moved):
        at = _pieces(count, size)
        places = [(at[k][0] + m, at[k][1]) for k, m in zip(which, moved)]
        inside = [(p >= 1) & (p + n - 1 <= F.length("key")) for p, n in places]
        made = F.struct(size.alias("size"), F.lit("-".join(map(str, which))).alias("which"), F.concat(*(F.substring("key", p, n) for p, n in places)).alias("said"))
        return F.when(reduce(and_, inside), made)

    every = list(combinations(range(count), held))
    size = F.length("key")
    own = F.array(*(block(size, which, (0,) * held) for which in every))
    asked = F.array(*(block(size - more, which, moved) for more, moved in _shifts(held, edits) for which in every))
    return keys.select(F.col("key").alias("other"), F.explode(own).alias("block")), keys.select(F.col("key").alias("one"), F.explode(F.array_distinct(F.array_compact(asked))).alias("block"))


def close_pairs(keys: DataFrame, *, edits: int = 2, q: int = 3, most_block: int = 200) -> DataFrame:
    """one, other (one < other): distinct strings of the column key that are at most so many edits apart.

    Strings need q * (edits + 1) + 1 letters at least, so that pieces have about q;
    shorter ones, and null, have no pairs. Blocks of more than most_block strings ask
    for two common pieces instead of one.
    """
    own = keys.select("key").where(F.length("key") >= q * (edits + 1) + 1).distinct().repartition(2 * keys.sparkSession.sparkContext.defaultParallelism)
    own = materialise(own, "keys")
    held, asked = _blocks(own, edits, 1)
    large = materialise(held.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > most_block).select("block"), "blocks")
    if large.isEmpty():
        return _met(held, asked, edits).distinct()
    met = _met(held.join(large, "block", "left_anti"), asked, edits)
    # strings of large blocks, as those that have the piece and as those that ask for it
    again, asking = (rows.join(large, "block", "left_semi").select(F.col(c).alias("key")).distinct() for rows, c in ((held, "other"), (asked, "one")))
    return met.unionByName(_met(_blocks(again, edits, 2)[0], _blocks(asking, edits, 2)[1], edits)).distinct()


def _met(held: DataFrame, asked: DataFrame, edits: int) -> DataFrame:
    """one < other of the strings that meet in a block and are so close."""
    close = asked.join(held, "block").where((F.col("one") != F.col("other")) & (F.levenshtein("one", "other", edits) >= 0))
    return close.select(F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other"))


def fused(names: DataFrame, *, edits: int = 2, q: int = 3, most_block: int = 200) -> DataFrame:
    """key and person: all spellings that edits lead from one to another are the one seen most often.

    names has key and n; of equal numbers the last spelling in order counts. Chains of any
    length are one. Null and empty keys go.
    """
    sized = materialise(names.where("key <> ''").groupBy("key").agg(F.sum("n").alias("n")), "names")
    pairs = close_pairs(sized, edits=edits, q=q, most_block=most_block)
    linked = components(pairs.select(F.col("one").alias("u"), F.col("other").alias("v")))
    met = sized.join(linked, F.col("key") == F.col("node"), "left").select("key", "n", F.coalesce("component", "key").alias("component"))
    best = met.groupBy("component").agg(F.max_by("key", F.struct("n", "key")).alias("person"))
    return met.join(best, "component").select("key", "person")
