"""Questions as data: a QuerySpec names a form and its conditions, compiled makes it a plan.

Every condition that is set has exactly one place in the plan; a form that cannot
honour one refuses it, rather than answer another question.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumframe.operators.joins import interval_join
from quorumframe.plans.facts import Facts

#: Results that count as approved.
APPROVED = ("aprobada", "aprobada con enmienda")


class NotExpressible(ValueError):
    """The question has no plan; saying so is an answer too."""


@dataclass(frozen=True)
class QuerySpec:
    form: str
    themes: tuple = ()
    groups: tuple = ()
    opposition_to: tuple = ()
    years: tuple[int, int] | None = None
    dates: tuple[dt.date, dt.date] | None = None  # half-open
    on: dt.date | None = None
    months: tuple[int, ...] = ()
    results: tuple[str, ...] = ()
    point_type: str | None = None
    unanimous: tuple[str, str, str] | None = None  # the words for in favour, against, abstaining
    voters: tuple = ()
    direction: str | None = None
    decisive: bool = False
    subset: tuple[str, ...] = ()  # results of the part, in ratios
    subject: bool = False  # points are those of the hits given to compiled
    limit: int | None = None
    criterion: str | None = None
    speakers: tuple[str, ...] = ()  # keys of speakers, such as alcalde

    def conditions(self) -> set[str]:
        return {f.name for f in fields(self) if f.name not in ("form", "limit", "criterion") and getattr(self, f.name) not in (None, (), False)}


_POINT_CONDITIONS = {"themes", "groups", "opposition_to", "years", "dates", "on", "months", "results", "point_type", "unanimous", "subject"}


class Form(NamedTuple):
    build: Callable
    honoured: set[str]
    limit: int | None
    limits_points: bool


FORMS: dict[str, Form] = {}


def form(name: str, *more: str, limit: int | None = None, points: bool = True, limits_points: bool = False):
    """Registers a form: the conditions it honours beside those on points, and its usual limit of rows.

    With limits_points the form itself applies the limit, to points, and what is joined to them stays whole.
    """

    def register(build):
        FORMS[name] = Form(build, (_POINT_CONDITIONS if points else set()) | set(more), limit, limits_points)
        return build

    return register


#: The column of a point that a condition needs, where it is not of the same name.
_COLUMN_OF = {"groups": "group_id", "opposition_to": "group_id"}


def selected(spec: QuerySpec, facts: Facts, *columns: str, hits: DataFrame | None = None) -> DataFrame:
    """The propositions that meet the conditions, with the columns asked for; with hits (point_id, relation) also the relation.

    A point without a group is in no opposition: nobody is known to have submitted it.
    """
    points = facts.propositions({*columns, *(_COLUMN_OF.get(c, c) for c in spec.conditions())})
    simple: list[tuple[object, Column]] = [
        (spec.groups, F.col("group_id").isin(*spec.groups)),
        (spec.opposition_to, ~F.col("group_id").isin(*spec.opposition_to)),
        (spec.years, F.col("year").between(*(spec.years or (0, 0)))),
        (spec.dates, (F.col("session_date") >= F.lit(spec.dates and spec.dates[0])) & (F.col("session_date") < F.lit(spec.dates and spec.dates[1]))),
        (spec.on, F.col("session_date") == F.lit(spec.on)),
        (spec.months, F.col("month").isin(*spec.months)),
        (spec.results, F.col("result").isin(*spec.results)),
        (spec.point_type, F.col("point_type") == F.lit(spec.point_type)),
    ]
    for wanted, condition in simple:
        if wanted:
            points = points.where(condition)
    if spec.themes:
        points = points.join(facts.treating(spec.themes), "point_id", "left_semi")
    if spec.unanimous:
        points = points.join(unanimous(facts.group_vote, *spec.unanimous), "point_id", "left_semi")
    if spec.subject:
        if hits is None:
            raise NotExpressible("a subject needs its hits")
        points = points.join(hits, "point_id")
    return points


def unanimous(group_vote: DataFrame, favour: str, against: str, abstain: str) -> DataFrame:
    """Points with a vote in favour and none of the other two, in one aggregation."""
    has = lambda word: F.bool_or(F.col("direction") == word)
    return group_vote.groupBy("point_id").agg(has(favour).alias("f"), has(against).alias("c"), has(abstain).alias("a")).where("f and not c and not a").select("point_id")


def compiled(spec: QuerySpec, facts: Facts, hits: DataFrame | None = None) -> DataFrame:
    if spec.form not in FORMS:
        raise NotExpressible(f"no form {spec.form}")
    found = FORMS[spec.form]
    if rest := spec.conditions() - found.honoured:
        raise NotExpressible(f"{spec.form} cannot honour {', '.join(sorted(rest))}")
    out = found.build(spec, facts, hits)
    limit = spec.limit if spec.limit is not None else found.limit
    if limit is not None and not found.limits_points:
        out = out.limit(limit)
    return out.withColumn("criterion", F.lit(spec.criterion)) if spec.criterion else out


def counted(df: DataFrame, *keys: str, of: str = "point_id") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(of).alias("n"))


def ranked(df: DataFrame, *keys: str, of: str = "point_id") -> DataFrame:
    """Counts of distinct points by key, the largest first; equal counts go by key."""
    return counted(df, *keys, of=of).orderBy(F.desc("n"), *keys)


@form("count")
def _(spec, facts, hits):
    return selected(spec, facts, hits=hits).agg(F.count_distinct("point_id").alias("n"))


@form("rank_group", limit=20)
def _(spec, facts, hits):
    return ranked(selected(spec, facts, "group_id", hits=hits).where("group_id is not null"), "group_id")


@form("breakdown_group")
def _(spec, facts, hits):
    return ranked(selected(spec, facts, "group_id", hits=hits).where("group_id is not null"), "group_id")


@form("rank_person", limit=15)
def _(spec, facts, hits):
    return ranked(selected(spec, facts, "person_id", hits=hits).where("person_id is not null"), "person_id")


@form("rank_place", limit=15)
def _(spec, facts, hits):
    return ranked(selected(spec, facts, "place_id", hits=hits).join(facts.place, "place_id"), "label")


@form("rank_district", limit=15)
def _(spec, facts, hits):
    placed = selected(spec, facts, "place_id", hits=hits).join(facts.place.select("place_id", "district_id"), "place_id")
    return ranked(placed.join(facts.district, "district_id"), "label")


@form("rank_session", limit=5)
def _(spec, facts, hits):
    return ranked(selected(spec, facts, hits=hits).join(facts.session, "session_date"), "session_date", "type")


@form("rank_term", limit=6)
def _(spec, facts, hits):
    return ranked(interval_join(selected(spec, facts, hits=hits), facts.term, "session_date", "start", "end", closed=False), "term_id")


@form("rank_year", limit=10)
def _(spec, facts, hits):
    return ranked(selected(spec, facts, hits=hits), "year")


@form("trend_year")
def _(spec, facts, hits):
    return counted(selected(spec, facts, hits=hits), "year").orderBy("year")


@form("theme_extreme", "direction", limit=1)
def _(spec, facts, hits):
    """The theme treated most, or least if direction is least."""
    by = counted(selected(spec, facts, hits=hits).join(facts.point_theme, "point_id"), "theme_id")
    return by.orderBy(F.asc("n") if spec.direction == "least" else F.desc("n"), "theme_id")


def listed(points: DataFrame) -> DataFrame:
    columns = ["point_id", "session_date", "group_id", "result", *(["relation"] if "relation" in points.columns else [])]
    return points.select(*columns).distinct().orderBy(F.desc("session_date"), "point_id")


@form("list", limit=40)
def _(spec, facts, hits):
    return listed(selected(spec, facts, "group_id", hits=hits))


@form("exists", limit=10)
def _(spec, facts, hits):
    return listed(selected(spec, facts, "group_id", hits=hits))


@form("last", limit=6)
def _(spec, facts, hits):
    """With a subject the three newest that treat it and the three that mention it; else the newest five."""
    points = selected(spec, facts, "group_id", hits=hits)
    if not spec.subject:
        return listed(points).limit(5)
    newest = [listed(points.where(F.col("relation") == r)).limit(3) for r in ("treats", "mentions")]
    return newest[0].unionByName(newest[1]).orderBy(F.desc("session_date"), "point_id")


@form("amounts", limit=25)
def _(spec, facts, hits):
    return selected(spec, facts, hits=hits).where("amount is not null").select("point_id", "session_date", "title", "amount", "person_id", "result").orderBy(F.desc("amount"), "point_id")


@form("votes", "voters", "decisive", limit=5, limits_points=True)
def _(spec, facts, hits):
    """The newest points first, then all their votes; points without any stay."""
    newest = listed(selected(spec, facts, "group_id", hits=hits)).limit(FORMS["votes"].limit if spec.limit is None else spec.limit)
    votes = facts.vote.where("is_decisive") if spec.decisive else facts.vote
    votes = votes.select("point_id", F.col("ord"), F.col("group_id").alias("voter"), "direction")
    if spec.voters:
        votes = votes.where(F.col("voter").isin(*spec.voters))
    return newest.join(votes, "point_id", "left")


@form("contents", limit=60)
def _(spec, facts, hits):
    newest = listed(selected(spec, facts, "group_id", hits=hits)).limit(8)
    said = facts.speech.select("point_id", "ord", "speaker", "summary")
    return newest.join(said, "point_id", "left").orderBy(F.desc("session_date"), "point_id", "ord")


@form("sessions", "years", "dates", points=False)
def _(spec, facts, hits):
    session = facts.session
    if spec.years:
        session = session.where(F.year("session_date").between(*spec.years))
    if spec.dates:
        session = session.where((F.col("session_date") >= F.lit(spec.dates[0])) & (F.col("session_date") < F.lit(spec.dates[1])))
    return session.groupBy("type").agg(F.count_distinct("session_date").alias("n"))


@form("first_session", "years", "dates", points=False)
def _(spec, facts, hits):
    """The first session of the period, with its points if it has any."""
    session = facts.session
    if spec.years:
        session = session.where(F.year("session_date").between(*spec.years))
    if spec.dates:
        session = session.where((F.col("session_date") >= F.lit(spec.dates[0])) & (F.col("session_date") < F.lit(spec.dates[1])))
    first = session.orderBy("session_date", "type").limit(1)
    return first.join(facts.point.select("session_date", "point_id", "title"), "session_date", "left")


@form("ratio", "subset")
def _(spec, facts, hits):
    return _with_share(selected(spec, facts, hits=hits), spec, [])


@form("ratio_groups", "subset")
def _(spec, facts, hits):
    return _with_share(selected(spec, facts, "group_id", hits=hits), spec, ["group_id"]).orderBy(*(["group_id"]))


def _with_share(points: DataFrame, spec: QuerySpec, keys: list[str]) -> DataFrame:
    """Total and part in one pass; the part is a conditional count, no second join."""
    part = F.when(F.col("result").isin(*(spec.subset or APPROVED)), F.col("point_id"))
    both = points.groupBy(*keys).agg(F.count_distinct("point_id").alias("total"), F.count_distinct(part).alias("part"))
    return both.withColumn("share", F.round(F.lit(100.0) * F.col("part") / F.expr("nullif(total, 0)"), 1))


@form("rank_amendments", limit=10)
def _(spec, facts, hits):
    return ranked(selected(spec, facts, hits=hits).select("point_id").join(facts.amendment, "point_id"), "group_id", of="amendment_id")


@form("count_amendments", "voters")
def _(spec, facts, hits):
    own = facts.amendment.where(F.col("group_id").isin(*spec.voters)) if spec.voters else facts.amendment
    return selected(spec, facts, hits=hits).select("point_id").join(own, "point_id").agg(F.count_distinct("amendment_id").alias("n"))


@form("group_votes", "voters", "direction")
def _(spec, facts, hits):
    votes = facts.group_vote.where(F.col("direction") == spec.direction) if spec.direction else facts.group_vote
    votes = votes.where(F.col("group_id").isin(*spec.voters)) if spec.voters else votes
    cast = votes.join(selected(spec, facts, hits=hits).select("point_id"), "point_id", "left_semi")
    return ranked(cast, "group_id", "direction")


@form("person_votes", "voters", "direction", limit=20)
def _(spec, facts, hits):
    """How often each person voted in each direction; voters are persons here."""
    votes = facts.person_vote.where(F.col("direction") == spec.direction) if spec.direction else facts.person_vote
    votes = votes.where(F.col("person_id").isin(*spec.voters)) if spec.voters else votes
    return ranked(votes.join(selected(spec, facts, hits=hits).select("point_id"), "point_id", "left_semi"), "person_id", "direction")


@form("rank_signers", limit=15)
def _(spec, facts, hits):
    return ranked(facts.signer.join(selected(spec, facts, hits=hits).select("point_id"), "point_id", "left_semi"), "person_id")


@form("group_year")
def _(spec, facts, hits):
    return counted(selected(spec, facts, "group_id", hits=hits).where("group_id is not null"), "group_id", "year").orderBy("group_id", "year")


@form("coauthors")
def _(spec, facts, hits):
    """Pairs of groups that amend the same point, by the number of such points.

    A point's groups are gathered once and paired where they are, so no point meets itself
    and each pair of a point is counted once as it is.
    """
    own = facts.amendment.select("point_id", "group_id").join(selected(spec, facts, hits=hits).select("point_id"), "point_id", "left_semi")
    met = own.groupBy("point_id").agg(F.sort_array(F.collect_set("group_id")).alias("groups")).where(F.size("groups") > 1)
    first = met.select("groups", F.posexplode("groups").alias("at", "one"))
    pairs = first.select("one", F.explode(F.slice("groups", F.col("at") + 2, F.size("groups"))).alias("other"))
    return pairs.groupBy("one", "other").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "one", "other")


def _said(spec: QuerySpec, facts: Facts) -> DataFrame:
    said = facts.speech.where(F.col("group_id").isin(*spec.voters)) if spec.voters else facts.speech
    return said.where(F.col("speaker").isin(*spec.speakers)) if spec.speakers else said


@form("rank_speaker", "voters", "speakers", limit=10, points=False)
def _(spec, facts, hits):
    return ranked(_said(spec, facts).where("speaker is not null"), "speaker", of="speech_id")


@form("rank_group_speeches", "speakers", limit=10, points=False)
def _(spec, facts, hits):
    return ranked(_said(spec, facts).where("group_id is not null"), "group_id", of="speech_id")


@form("count_speeches", "voters", "speakers", points=False)
def _(spec, facts, hits):
    return _said(spec, facts).agg(F.count_distinct("speech_id").alias("n"))
