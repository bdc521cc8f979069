"""A census of people from who was present when: one person for all spellings of a name, with group, interval and office."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumframe.functions.submitters import surname_variants
from quorumframe.functions.text import col, folded
from quorumframe.operators.joins import holds, named_at
from quorumframe.operators.similar import fused


def person_key(c: Column | str) -> Column:
    """Letters of a folded name only, so that blanks and signs that a scan lost or made up say nothing."""
    return F.regexp_replace(folded(c), "[^a-z]", "")


def best_name(name: Column | str) -> Column:
    """What orders the spellings of a name: at most twelve words, then the most letters, then not all in capitals, then the name itself."""
    name = col(name)
    return F.struct((F.size(F.split(name, r"\s+")) <= 12).alias("short"), F.length(person_key(name)).alias("long"), (name != F.upper(name)).alias("cased"), name.alias("name"))


def fused_keys(names: DataFrame, *, near: int = 2) -> DataFrame:
    """key and person: spellings that lead to one another by at most near letters a step are one, named by the one seen most often; see similar.fused."""
    return fused(names, edits=near)


def census(seen: DataFrame, *, near: int = 2) -> DataFrame:
    """One row for each person of seen (name, group, date, is_mayor): person, name, group, first, last, n and ever_mayor.

    group is the one a person was seen with most often, the first in order of equal ones.
    """
    keyed = seen.where("name is not null").withColumn("key", person_key("name"))
    fused = fused_keys(keyed.groupBy("key").agg(F.count("*").alias("n")), near=near)
    met = keyed.join(fused, "key")
    by_group = met.where("group is not null").groupBy("person", "group").agg(F.count("*").alias("_n"))
    group = by_group.groupBy("person").agg(F.min_by("group", F.struct(-F.col("_n"), F.col("group"))).alias("group"))
    facts = met.groupBy("person").agg(F.max_by("name", best_name("name")).alias("name"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("n"), F.coalesce(F.bool_or("is_mayor"), F.lit(False)).alias("ever_mayor"))
    return facts.join(group, "person", "left").select("person", "name", "group", "first", "last", "n", "ever_mayor")


def surname_index(people: DataFrame) -> DataFrame:
    """surname and person with first, last and group: each form under which a person's surnames appear."""
    return people.select(F.explode(surname_variants("name")).alias("surname"), "person", "first", "last", "group")


def people_named(asked: DataFrame, people: DataFrame) -> DataFrame:
    """asked (surname, date, group) with the one person who is meant: active at the date, of the group if one is given; null where several are."""
    upper = asked.select(F.upper(folded("surname")).alias("surname"), "date", "group")
    return named_at(upper, surname_index(people), "surname", "date", "person", "first", "last", hint="group")


def groups_named(asked: DataFrame, people: DataFrame) -> DataFrame:
    """asked (surname, date) with the one group of all who may be meant; dates count only where several groups are left."""
    own = surname_index(people).where("group is not null")
    met = asked.select(F.upper(folded("surname")).alias("surname"), "date").distinct().join(own, "surname")
    active = holds("date", "first", "last")
    one = met.groupBy("surname", "date").agg(F.count_distinct("group").alias("_all"), F.min("group").alias("_any"), F.count_distinct(F.when(active, F.col("group"))).alias("_n"), F.min(F.when(active, F.col("group"))).alias("_one"))
    return one.select("surname", "date", F.when(F.col("_all") == 1, F.col("_any")).when(F.col("_n") == 1, F.col("_one")).alias("group"))


def entities_as_people(entities: DataFrame, people: DataFrame) -> DataFrame:
    """entities (entity_id, label) with the person of the same name in its place, if there is just one."""
    named = people.select(person_key("name").alias("_key"), "person").groupBy("_key").agg(F.count_distinct("person").alias("_n"), F.min("person").alias("_person")).where("_n = 1")
    return entities.join(named, person_key("label") == F.col("_key"), "left").select(F.coalesce("_person", F.col("entity_id").cast("string")).alias("entity_id"), "label", F.col("_person").isNotNull().alias("is_person"))
