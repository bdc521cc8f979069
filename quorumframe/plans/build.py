"""From raw minutes to typed tables, stage by stage, each a DataFrame from DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.functions import agenda as A
from quorumframe.functions import minutes as M
from quorumframe.functions.submitters import submitting_group
from quorumframe.functions.text import folded, short_id
from quorumframe.functions.votes import result_text, vote_events
from quorumframe.operators.groups import decisive
from quorumframe.operators.joins import patched
from quorumframe.operators.matching import places_in
from quorumframe.plans.census import groups_named
from quorumframe.plans.facts import Facts
from quorumframe.plans.nominal import group_votes, person_votes
from quorumframe.storage import materialise


def sessions(texts: DataFrame) -> DataFrame:
    """file, session_date and type of minutes (file, text); files whose names tell no day go."""
    named = texts.select("file", A.session_of("file").alias("s"))
    return named.select("file", F.col("s.date").alias("session_date"), F.col("s.kind").alias("type")).where("session_date is not null")


def agenda_points(texts: DataFrame) -> DataFrame:
    """point_id, file, session_date, number, title and text of each point of the minutes (file, text)."""
    clean = texts.select("file", A.without_furniture("text").alias("text"))
    cut = A.segments(clean, "file", "text").withColumn("title", A.point_title("text"))
    held = A.points(cut, "file").join(sessions(texts), "file")
    return held.select(short_id(F.col("session_date"), F.col("title")).alias("point_id"), "file", "session_date", "type", "number", "title", "text")


def typed_points(points: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Points with what their titles and texts say: group, type, result and its source, amount, submission date.

    corrections (point_id, at and any of group_id, point_type, result, amount) replaces what was read, the last
    of each point; a null there deletes it.
    """
    group = submitting_group("title", "text")
    named = points.withColumn("group_id", F.when(group != M.UNKNOWN, group)).withColumn("vote_text", result_text("text"))
    said = M.recovered_result(F.coalesce("vote_text", F.lit("")), F.col("text").rlike(r"(?i)\benmiendas?\b"))
    read = named.select(
        "point_id", "file", "session_date", F.year("session_date").alias("year"), F.month("session_date").alias("month"), "number", "title", "text", "group_id",
        M.point_type("title", "group_id").alias("point_type"), said["result"].alias("result"), said["source"].alias("result_source"), M.main_amount("title").alias("amount"), M.submitted_on("title", F.year("session_date")).alias("submitted_on"),
    )
    return read if corrections is None else patched(read, corrections, "point_id", "at")


def votes(points: DataFrame) -> DataFrame:
    """point_id, ord, object, cast, favour, against, abstain, decision and is_decisive of each vote taken on a point."""
    return decisive(vote_events(points, "point_id", "text"), ["point_id"], "ord")


def speeches(points: DataFrame) -> DataFrame:
    """speech_id, point_id, ord, speaker (a key), surname (as the label has it, null for an office) and text of each speech on a point."""
    said = M.speeches(points, "point_id", "text")
    bare = F.btrim(F.regexp_replace("speaker", r"^(?:SRES?\.|SRA\.|SR\.) | (?:AND|JN)\.?$", ""))
    key = M.speaker_key("speaker")
    return said.select(short_id("point_id", "ord", method="sha1").alias("speech_id"), "point_id", "ord", key.alias("speaker"), F.when(~key.isin("alcalde", "secretario"), bare).alias("surname"), "text")


def facts_of(texts: DataFrame, corrections: DataFrame | None = None, *, people: DataFrame | None = None, places: DataFrame | None = None) -> Facts:
    """The typed tables of raw minutes (file, text), for questions to be asked of.

    With people, a census, votes have a row for each group whose members voted by name,
    and speeches the group of their speaker at the date. With places (place_id, name)
    points have the first place that their title names. Without them these are null.
    """
    points = agenda_points(texts)
    read = typed_points(points, corrections)
    own = ["point_id", "session_date", "year", "month", "title", "point_type", "group_id"]
    if places is None:
        placed = read.withColumn("place_id", F.lit(None).cast("string"))
    else:
        found = places_in(read.dropDuplicates(["point_id"]), "point_id", "title", places).groupBy("point_id").agg(F.min("place_id").cast("string").alias("place_id"))
        placed = read.join(found, "point_id", "left")
    held = placed.select(*own, F.lit(None).cast("string").alias("person_id"), "place_id", "result", "amount")

    def vote_rows() -> DataFrame:
        taken = votes(read)
        nobody = taken.select("point_id", "ord", F.lit(None).cast("string").alias("group_id"), F.col("decision").alias("direction"), "is_decisive")
        if people is None:
            return nobody
        taken = materialise(taken, "votes")
        by_group = group_votes(person_votes(read, taken, people)).select("point_id", "ord", F.col("group").alias("group_id"), "direction")
        named = by_group.join(taken.select("point_id", "ord", "is_decisive"), ["point_id", "ord"]).select("point_id", "ord", "group_id", "direction", "is_decisive")
        return named.unionByName(nobody.join(by_group.select("point_id", "ord").distinct(), ["point_id", "ord"], "left_anti"))

    def speech_rows() -> DataFrame:
        said = speeches(read)
        if people is None:
            return said.select("speech_id", "point_id", "ord", "speaker", F.lit(None).cast("string").alias("group_id"), F.col("text").alias("summary"))
        dated = said.join(read.groupBy("point_id").agg(F.min("session_date").alias("date")), "point_id").withColumn("_name", F.upper(folded("surname")))
        groups = groups_named(dated.where("surname is not null").select("surname", "date"), people).select(F.col("surname").alias("_name"), "date", F.col("group").alias("group_id"))
        return dated.join(groups, ["_name", "date"], "left").select("speech_id", "point_id", "ord", "speaker", "group_id", F.col("text").alias("summary"))

    return Facts(point=held, vote=vote_rows, speech=speech_rows, session=lambda: sessions(texts).select("session_date", "type"))
