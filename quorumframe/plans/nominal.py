"""Votes of persons: lists of names in minutes, placed on the votes that were taken, and what follows for persons, groups and counts.

A point's text is read in order, and has votes and lists of names. A list belongs to the
vote whose counts it comes nearest to, and of votes equally near to the one it stands
nearest to; each vote has one list of names and each list one vote. Several fragments may
hold the same point, so a vote can be told more than once: the fullest telling counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumframe.functions.decisions import any_of
from quorumframe.functions.minutes import named_list
from quorumframe.functions.text import bound
from quorumframe.functions.votes import vote_pieces
from quorumframe.operators.groups import majority
from quorumframe.operators.matching import matched_once
from quorumframe.plans.census import groups_named, people_named
from quorumframe.storage import materialise

#: The words before a list of names, by the direction of the vote.
DIRECTIONS = {"favour": ("votos afirmativos", "votos a favor"), "against": ("votos negativos", "votos en contra"), "abstain": ("abstenciones", "abstencion", "abstención")}
#: Courtesy before names.
COURTESY = ("señores", "señoras", "señor", "señora", "sres.", "sras.", "sr.", "sra.", "dña.", "don", "doña")
_LABEL = {name: f"(?i){any_of(words).replace('(', '(?:', 1)}" for name, words in DIRECTIONS.items()}
_ANY = f"(?i){any_of(w for words in DIRECTIONS.values() for w in words).replace('(', '(?:', 1)}|votos emitidos"


def _list_after(label: str) -> Callable[[Column], Column]:
    """What gives declared and names of the list after a label in a piece: up to the next label or full stop, without courtesies."""
    return lambda piece: _named_after(piece, label)


_COURTESIES = rf"(?i)(?<![\p{{L}}]){any_of(w.replace('.', chr(92) + '.') for w in COURTESY)}(?:\s*/\s*as)?(?![\p{{L}}])"


def _named_after(piece: Column, label: str) -> Column:
    after = F.try_element_at(F.split(F.regexp_replace(piece, _COURTESIES, " "), label, 2), F.lit(2))
    own = F.element_at(F.split(F.coalesce(after, F.lit("")), rf"{_ANY}|\.(?= |$)", 2), 1)
    declared = r"^\s*[:=(]?\s*(\d{1,3})?\s*[:,(;.-]?"
    return F.struct(F.regexp_extract(own, declared, 1).try_cast("int").alias("declared"), named_list(F.regexp_replace(own, declared, " ")).alias("names"))


def lists_of(points: DataFrame) -> DataFrame:
    """point_id, list_id, at, favour, against, abstain (names, arrays) and declared (their numbers as stated, null where not) of each telling of a vote by name.

    points has point_id and text, several rows for a point that several fragments hold; at
    is the place of the telling in its text.
    """
    rows = materialise(points.select("point_id", "text").withColumn("_row", F.monotonically_increasing_id()), "fragments")
    pieces = vote_pieces(rows, "_row", "text")
    told = pieces.select("_row", F.col("ord").alias("at"), *(bound(F.col("piece"), _list_after(label)).alias(name) for name, label in _LABEL.items()))
    named = told.where(sum((F.size(f"{d}.names") for d in DIRECTIONS), F.lit(0)) > 0)
    placed = named.join(rows.select("_row", "point_id"), "_row").withColumn("list_id", F.xxhash64("_row", "at"))
    return placed.select("point_id", "list_id", "at", *(F.col(f"{d}.names").alias(d) for d in DIRECTIONS), F.struct(*(F.col(f"{d}.declared").alias(d) for d in DIRECTIONS)).alias("declared"))


def placed_lists(lists: DataFrame, votes: DataFrame, *, most_off: int = 2) -> DataFrame:
    """point_id, ord and list_id: each list on one vote of its point, each vote with one list.

    lists has point_id, list_id, at and the numbers favour, against and abstain; votes has
    point_id, ord and the same numbers, null counting as zero. Counts may be most_off
    votes apart in all, as lists are cut off or run on; nearer counts come first, then
    nearer places.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = lists.select("point_id", "list_id", "at", *(number(d).alias(f"_{d}") for d in DIRECTIONS))
    both = own.join(votes.select("point_id", "ord", *(number(d).alias(d) for d in DIRECTIONS)), "point_id")
    off = sum((F.abs(F.col(d) - F.col(f"_{d}")) for d in DIRECTIONS), F.lit(0))
    near = both.withColumn("off", off).where(F.col("off") <= most_off)
    score = 1 / (1 + F.col("off") + F.abs(F.col("at") - F.col("ord")) / 1000.0)
    return matched_once(near.withColumn("score", score), "point_id", "ord", "list_id", "score", least=0.0).select("point_id", "ord", "list_id")


def fullest_lists(lists: DataFrame) -> DataFrame:
    """Of tellings with the same declared numbers of one point the one with the most names; lists whose numbers are not all declared are each their own."""
    size = sum((F.size(d) for d in DIRECTIONS), F.lit(0))
    stated = F.when(F.col("declared.favour").isNotNull() & F.col("declared.against").isNotNull(), F.to_json("declared")).otherwise(F.col("list_id").cast("string"))
    rest = [c for c in lists.columns if c != "point_id"]
    return lists.groupBy("point_id", stated.alias("_told")).agg(F.max_by(F.struct(*rest), F.struct(size, -F.col("at"), "list_id")).alias("_best")).select("point_id", "_best.*")


def _in_direction(direction: str) -> Callable[[Column], Column]:
    return lambda name: F.struct(name.alias("name"), F.lit(direction).alias("direction"))


def person_votes(points: DataFrame, votes: DataFrame, people: DataFrame) -> DataFrame:
    """point_id, ord, name, direction, person and group of each name in the list of a vote.

    points has point_id, session_date and text; votes are those of build.votes; people is
    a census. person is null where the name means nobody or several at that date, and
    group where those it may mean are of several groups.
    """
    lists = fullest_lists(lists_of(points))
    sizes = lists.select("point_id", "list_id", "at", *(F.coalesce(F.col(f"declared.{d}"), F.size(d)).alias(d) for d in DIRECTIONS))
    placed = placed_lists(sizes, votes)
    each = lists.join(placed, ["point_id", "list_id"]).select("point_id", "ord", F.explode(F.flatten(F.array(*(F.transform(d, _in_direction(d)) for d in DIRECTIONS)))).alias("v")).select("point_id", "ord", "v.*")
    dated = each.join(points.groupBy("point_id").agg(F.min("session_date").alias("date")), "point_id")
    asked = dated.select(F.col("name").alias("surname"), "date", F.lit(None).cast("string").alias("group")).distinct()
    person, group = (t.withColumnRenamed("surname", "_surname").drop(*drop) for t, drop in ((people_named(asked, people), ["group"]), (groups_named(asked, people), [])))
    key = dated.withColumn("_surname", F.upper(F.translate("name", "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")))
    return key.join(person, ["_surname", "date"], "left").join(group, ["_surname", "date"], "left").select("point_id", "ord", "name", "direction", "person", "group")


def group_votes(by_person: DataFrame, *, share: float = 0.75) -> DataFrame:
    """point_id, ord, group and direction: that of at least share of a group's recognised members."""
    return majority(by_person.where("group is not null"), ["point_id", "ord", "group"], "direction", share)


def corrected_counts(votes: DataFrame, told: DataFrame) -> DataFrame:
    """votes with corrected, and favour, against and abstain of the one telling of the point that adds up, where their own do not.

    Both have point_id, cast, favour, against and abstain. A telling agrees with a vote of
    the same votes cast if it adds up to them and has each count that the vote has, a
    count of zero or null being one it lacks. Where tellings that agree differ, or none
    does, a vote stays as it is.
    """
    counts = list(DIRECTIONS)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    adds_up = sum((zero(c) for c in counts), F.lit(0)) == F.col("cast")
    right = told.where(adds_up).select("point_id", "cast", *(zero(c).alias(f"_{c}") for c in counts)).distinct()
    numbered = materialise(votes.withColumn("_row", F.monotonically_increasing_id()), "votes")
    wrong = numbered.where(~F.coalesce(adds_up, F.lit(True)))
    agrees = None
    for c in counts:
        own = (zero(c) == 0) | (zero(c) == F.col(f"_{c}"))
        agrees = own if agrees is None else agrees & own
    met = wrong.join(right, ["point_id", "cast"]).where(agrees)
    one = met.groupBy("_row").agg(F.count("*").alias("_n"), *(F.min(f"_{c}").alias(f"_{c}") for c in counts)).where("_n = 1")
    fixed = numbered.join(one, "_row", "left")
    found = F.col("_n").isNotNull()
    return fixed.select(*(F.when(found, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in counts else F.col(c) for c in votes.columns), found.alias("corrected"))
