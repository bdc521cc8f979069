"""From questions in prose to specifications: themes by their labels, sessions by their dates, and what a specification leaves out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quorumframe.functions import questions as Q
from quorumframe.functions.text import folded, stem, words
from quorumframe.operators.matching import contained_labels
from quorumframe.plans.spec import FORMS, NotExpressible, QuerySpec
from quorumframe.storage import materialise


def themes_of(questions: DataFrame, themes: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    """key, themes and labels of the labels (theme_id, label) that a text holds; one that stands inside another that was found is not meant."""
    held = contained_labels(questions, key, text, themes, "theme_id", "label")
    each = held.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("theme_id", "label"))).alias("_held"))
    padded = lambda x: F.concat(F.lit(" "), x["label"], F.lit(" "))
    own = F.filter("_held", lambda x: ~F.exists("_held", lambda y: (F.length(y["label"]) > F.length(x["label"])) & F.contains(padded(y), padded(x))))
    return each.withColumn("_held", own).select(key, F.array_distinct(F.transform("_held", lambda x: x["theme_id"])).alias("themes"), F.array_distinct(F.transform("_held", lambda x: x["label"])).alias("labels"))


def analysed(questions: DataFrame, themes: DataFrame, *, first_year: int, last_year: int, terms: Sequence[tuple[dt.date, dt.date | None]] = ()) -> DataFrame:
    """questions (question_id, question) with all that their texts ask for, one row per row.

    form, day, months, period, result, groups, submitters, flags, themes, labels and
    words, the stems of what is left. All is column expressions but the themes, which
    are one join on the labels.
    """
    met = questions.join(themes_of(questions, themes), "question_id", "left")
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    covered = F.flatten(F.transform(labels, lambda label: F.transform(F.split(label, " "), stem)))
    q = "question"
    return met.select(
        "question_id", q, Q.form_of(q).alias("form"), Q.day_of(q).alias("day"), Q.months_of(q).alias("months"), Q.period_of(q, first_year, last_year, terms).alias("period"), Q.result_asked(q).alias("result"),
        Q.groups_of(q).alias("groups"), Q.submitters_of(q).alias("submitters"), Q.flags_of(q).alias("flags"), F.coalesce("themes", F.array().cast(met.schema["themes"].dataType)).alias("themes"), labels.alias("labels"), Q.subject_words(q, covered).alias("words"),
    )


def spec_of(row: Row, *, results: Mapping[str, tuple[str, ...]], unanimous: tuple[str, str, str] | None = None, government: tuple = (), group_ids: Mapping[str, object] | None = None) -> QuerySpec:
    """The specification of one analysed question.

    results says which values stand for a result that is asked for, unanimous the words
    of the three directions, government who is not in opposition, group_ids the key of a
    group's name. Raises NotExpressible if no form is shown.
    """
    if row["form"] is None:
        raise NotExpressible("the question shows no form")
    if row["flags"]["out_of_scope"] == "asistencia":
        raise NotExpressible("who attended is not recorded")
    named = lambda groups: tuple((group_ids or {}).get(g, g) for g in groups)
    votes = row["form"] in ("votes", "group_votes", "person_votes")
    asked = tuple(g for g in row["groups"] if g not in row["submitters"]) if votes else ()
    period, honoured = row["period"], FORMS[row["form"]].honoured
    share = row["form"] in ("ratio", "ratio_groups")
    wanted = results.get(row["result"], ()) if row["result"] else ()
    return QuerySpec(
        row["form"],
        themes=tuple(row["themes"]),
        groups=named(g for g in row["groups"] if g not in asked),
        voters=named(asked) if "voters" in honoured else (),
        opposition_to=tuple(government) if row["flags"]["opposition"] else (),
        years=(period["since"], period["until"]) if period["since"] is not None and period["start"] is None and row["day"] is None else None,
        dates=(period["start"], period["end"] or dt.date(9999, 12, 31)) if period["start"] is not None else None,
        on=row["day"],
        months=tuple(row["months"]) if row["day"] is None else (),
        results=() if share else wanted,
        subset=wanted if share else (),
        unanimous=unanimous if row["flags"]["unanimous"] else None,
        point_type="proposicion_ciudadana" if row["flags"]["by_citizens"] else None,
        direction="least" if row["form"] == "theme_extreme" and " menos " in f" {row['question'].lower()} " else None,
    )


def uncovered(row: Row, spec: QuerySpec) -> list[str]:
    """What a question asks for and its specification does not say, and the other way round; an answer to another question is worse than none."""
    period = row["period"]
    asked = {
        "themes": bool(row["themes"]), "groups": bool(row["groups"]), "on": row["day"] is not None, "months": bool(row["months"]) and row["day"] is None, "results": row["result"] is not None,
        "period": (period["since"] is not None or period["start"] is not None) and row["day"] is None, "unanimous": row["flags"]["unanimous"], "opposition_to": row["flags"]["opposition"], "subject": bool(row["words"]), "fiscal": period["fiscal"] is not None,
    }
    said = {
        "themes": bool(spec.themes), "groups": bool(spec.groups or spec.voters), "on": spec.on is not None, "months": bool(spec.months), "results": bool(spec.results or spec.subset),
        "period": spec.years is not None or spec.dates is not None, "unanimous": spec.unanimous is not None, "opposition_to": bool(spec.opposition_to), "subject": spec.subject, "fiscal": False,
    }
    return sorted(name for name in asked if bool(asked[name]) != said[name])


def sessions_of(questions: DataFrame, sessions: DataFrame, *, first_year: int, last_year: int) -> DataFrame:
    """question_id, session_date of the sessions that a question means: the one of its day, else those of its month; those of its months or its year."""
    cores = 2 * questions.sparkSession.sparkContext.defaultParallelism
    # a text is read once, however many ask it; the sessions of a day and its months are settled before questions meet them, so no pair is shuffled
    texts = questions.select("question").where("question is not null").distinct().repartition(cores)
    texts = materialise(texts.select("question", Q.day_of("question").alias("_day"), Q.session_months("question", first_year, last_year).alias("_months")).where(F.size("_months") > 0), "questions")
    held = sessions.select("session_date").distinct().select("session_date", F.year("session_date").alias("_year"), F.month("session_date").alias("_month"))
    periods = texts.select("_day", "_months").distinct().select("_day", "_months", F.explode("_months").alias("_m"))
    met = periods.join(held, (F.col("_m.year") == F.col("_year")) & (F.col("_m.month") == F.col("_month"))).groupBy("_day", "_months").agg(F.array_sort(F.collect_set("session_date")).alias("_held"))
    exact = F.array_contains("_held", F.col("_day"))  # null days hit nothing
    meant = met.select(F.col("_day").alias("_d"), F.col("_months").alias("_ms"), F.when(exact, F.array("_day")).otherwise(F.col("_held")).alias("_sessions"))
    # rows are few and small before they are given their sessions, so they are dealt to all cores first; days and months are as many as the calendar has
    asked = questions.select("question_id", "question").join(texts, "question").select("question_id", "_day", "_months").distinct().repartition(cores, "question_id")
    found = asked.join(F.broadcast(meant), F.col("_day").eqNullSafe(F.col("_d")) & (F.col("_months") == F.col("_ms")))
    return found.select("question_id", F.explode("_sessions").alias("session_date"))


def subject_fields(points: DataFrame, *, themes: DataFrame | None = None, entities: DataFrame | None = None, speeches: DataFrame | None = None) -> DataFrame:
    """point_id, text and is_about of all that may name a point's subject: its title and the labels of its themes are about it; entities and what is said only mention it.

    themes and entities have point_id and label, speeches has point_id and summary.
    """
    parts = [points.select("point_id", F.col("title").alias("text"), F.lit(True).alias("is_about"))]
    for more, column, about in ((themes, "label", True), (entities, "label", False), (speeches, "summary", False)):
        if more is not None:
            parts.append(more.select("point_id", F.col(column).alias("text"), F.lit(about).alias("is_about")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("text is not null")


def hits_or_themes(hits: DataFrame, treating: DataFrame) -> DataFrame:
    """point_id and relation: points that hold the subject, and those that treat a theme that stands for it; one that does both treats it."""
    both = hits.unionByName(treating.select("point_id", F.lit("treats").alias("relation")))
    return both.groupBy("point_id").agg(F.max("relation").alias("relation"))  # treats comes after mentions


def theme_labels(taxonomy: DataFrame) -> DataFrame:
    """theme_id and label of each preferred and alternative label; of a label that several themes have the preferred one's, then the first theme, has it."""
    every = taxonomy.select("theme_id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("k"), F.col("label").alias("l"))), F.transform("alternatives", lambda a: F.struct(F.lit(1).alias("k"), a.alias("l"))))).alias("x"))
    first = every.where("x.l is not null").groupBy(folded("x.l").alias("_folded")).agg(F.min(F.struct("x.k", "theme_id", "x.l")).alias("_first"))
    return first.select("_first.theme_id", F.col("_first.l").alias("label"))


def specific_words(asked: DataFrame, fields: DataFrame, *, most_share: float = 0.03) -> DataFrame:
    """question_id, word, df of the subject words (question_id, words) that few points use, or that hold a digit; the rarest first is up to the caller.

    fields has point_id and text. Only words that are asked for leave the texts.
    """
    each = asked.select("question_id", F.explode("words").alias("word"))
    points = fields.agg(F.count_distinct("point_id").alias("_points"))  # one row
    used = fields.select("point_id", F.explode(F.array_distinct(F.transform(words("text"), stem))).alias("word"))
    df = used.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count_distinct("point_id").alias("df"))
    rare = (F.coalesce("df", F.lit(0)) <= most_share * F.col("_points")) | F.col("word").rlike(r"\d")
    return each.join(df, "word", "left").join(F.broadcast(points)).where(rare).select("question_id", "word", F.coalesce("df", F.lit(0).cast("long")).alias("df"))


def alternatives_of(asked: Sequence[str], rarest: Sequence[str]) -> list[list[list[str]]]:
    """The ladder of a subject's alternatives for subject_hits: all words, then the specific ones, then the rarest alone; steps without words go."""
    steps = [list(asked), [w for w in asked if w in set(rarest)], list(rarest[:1])]
    return [[step] for k, step in enumerate(steps) if step and step not in steps[:k]]


def label_pattern(label: Column | str) -> Column:
    """A pattern for a label in folded text, each word in singular or plural; for rlike."""
    return F.concat(F.lit(r"\b"), F.regexp_replace(folded(label), r"([a-z]{3,}?)(?:es|s)?(?= |$)", "$1(?:es|s)?"), F.lit(r"\b"))
