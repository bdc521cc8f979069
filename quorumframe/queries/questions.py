"""The forms of questions, compiled from specifications over the star schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quorumframe.plans.facts import star_schema_facts
from quorumframe.plans.spec import QuerySpec, compiled, selected, unanimous
from quorumframe.registry import query

_POINT = """
WITH point AS (
  SELECT o_orderkey AS point_id, CAST(o_orderdate AS DATE) AS session_date, year(o_orderdate) AS year, month(o_orderdate) AS month,
         'Order ' || o_orderkey AS title, o_orderpriority AS point_type, c_mktsegment AS group_id, o_custkey AS person_id,
         c_nationkey AS place_id, o_orderstatus AS result, o_totalprice AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey
), line AS (SELECT lineitem.*, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
"""
_SESSION = ", session AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session_date, CASE WHEN day(o_orderdate) = 1 THEN 'constitutive' ELSE 'ordinary' END AS type FROM orders)"


def _register(name: str, spec: QuerySpec, sql: str) -> None:
    query(name, _POINT + sql)(lambda spark, folder: compiled(spec, star_schema_facts(spark, folder)))


_register("count_total", QuerySpec("count"), "SELECT count(DISTINCT point_id) AS n FROM point")
_register(
    "count_filtered",
    QuerySpec("count", groups=("BUILDING", "MACHINERY"), years=(1996, 1998), results=("F", "P")),
    "SELECT count(DISTINCT point_id) AS n FROM point WHERE group_id IN ('BUILDING', 'MACHINERY') AND year BETWEEN 1996 AND 1998 AND result IN ('F', 'P')",
)
_register(
    "count_theme",
    QuerySpec("count", themes=(1002,), months=(3, 4, 5)),
    """SELECT count(DISTINCT point_id) AS n FROM point WHERE month IN (3, 4, 5) AND EXISTS (
  SELECT 1 FROM line JOIN nation ON s_nationkey = n_nationkey WHERE l_orderkey = point_id AND n_regionkey = 2)""",
)
_register("rank_group", QuerySpec("rank_group"), "SELECT group_id, count(DISTINCT point_id) AS n FROM point GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
_register("breakdown_group", QuerySpec("breakdown_group", results=("F",)), "SELECT group_id, count(DISTINCT point_id) AS n FROM point WHERE result = 'F' GROUP BY 1")
_register("rank_submitter", QuerySpec("rank_person"), "SELECT person_id, count(DISTINCT point_id) AS n FROM point GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
_register("rank_place", QuerySpec("rank_place", years=(1997, 1997)), "SELECT n_name AS label, count(DISTINCT point_id) AS n FROM point JOIN nation ON place_id = n_nationkey WHERE year = 1997 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
_register(
    "rank_district", QuerySpec("rank_district"), "SELECT r_name AS label, count(DISTINCT point_id) AS n FROM point JOIN nation ON place_id = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15"
)
_register("rank_session", QuerySpec("rank_session"), _SESSION + " SELECT session_date, type, count(DISTINCT point_id) AS n FROM point JOIN session USING (session_date) GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5")
_TERM = "(VALUES (1, DATE '1995-01-01', DATE '1997-06-15'), (2, DATE '1997-06-15', DATE '1999-06-15'), (3, DATE '1999-06-15', DATE '2003-06-15')) AS term(term_id, a, b)"
_register("rank_legislature", QuerySpec("rank_term"), f"SELECT term_id, count(DISTINCT point_id) AS n FROM point JOIN {_TERM} ON session_date >= a AND session_date < b GROUP BY 1 ORDER BY n DESC, 1 LIMIT 6")
_register("rank_year", QuerySpec("rank_year", point_type="1-URGENT"), "SELECT year, count(DISTINCT point_id) AS n FROM point WHERE point_type = '1-URGENT' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
_register("trend_year", QuerySpec("trend_year", groups=("BUILDING",)), "SELECT year, count(DISTINCT point_id) AS n FROM point WHERE group_id = 'BUILDING' GROUP BY 1")
_register(
    "ratio_total_subset", QuerySpec("ratio", years=(1996, 1999), subset=("F",)),
    "SELECT count(DISTINCT point_id) AS total, count(DISTINCT CASE WHEN result = 'F' THEN point_id END) AS part, round(100.0 * part / nullif(total, 0), 1) AS share FROM point WHERE year BETWEEN 1996 AND 1999",
)
_register(
    "ratio_multigroup", QuerySpec("ratio_groups", groups=("BUILDING", "FURNITURE", "no such group"), subset=("F", "P")),
    "SELECT group_id, count(DISTINCT point_id) AS total, count(DISTINCT CASE WHEN result IN ('F', 'P') THEN point_id END) AS part, round(100.0 * part / nullif(total, 0), 1) AS share FROM point WHERE group_id IN ('BUILDING', 'FURNITURE', 'no such group') GROUP BY 1",
)
_register("list_points", QuerySpec("list", on=dt.date(1997, 3, 4)), "SELECT DISTINCT point_id, session_date, group_id, result FROM point WHERE session_date = DATE '1997-03-04' ORDER BY session_date DESC, point_id LIMIT 40")
_register(
    "exists_topic", QuerySpec("exists", themes=(3,), dates=(dt.date(1998, 1, 1), dt.date(1998, 7, 1)), criterion="theme 3, first half of 1998"),
    """SELECT DISTINCT point_id, session_date, group_id, result, 'theme 3, first half of 1998' AS criterion FROM point
WHERE session_date >= DATE '1998-01-01' AND session_date < DATE '1998-07-01' AND EXISTS (SELECT 1 FROM line WHERE l_orderkey = point_id AND s_nationkey = 3) ORDER BY session_date DESC, point_id LIMIT 10""",
)
_register("opposition", QuerySpec("rank_group", opposition_to=("BUILDING", "HOUSEHOLD")), "SELECT group_id, count(DISTINCT point_id) AS n FROM point WHERE group_id NOT IN ('BUILDING', 'HOUSEHOLD') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
_register("amounts_largest", QuerySpec("amounts", results=("O",)), "SELECT point_id, session_date, title, amount, person_id, result FROM point WHERE result = 'O' AND amount IS NOT NULL ORDER BY amount DESC, point_id LIMIT 25")
_register(
    "votes_latest5", QuerySpec("votes", results=("F",)),
    """, newest AS (SELECT DISTINCT point_id, session_date, group_id, result FROM point WHERE result = 'F' ORDER BY session_date DESC, point_id LIMIT 5)
SELECT newest.*, l_linenumber AS ord, s_nationkey AS voter, l_returnflag AS direction FROM newest LEFT JOIN line ON l_orderkey = point_id""",
)
_register(
    "votes_limited", QuerySpec("votes", results=("P",), limit=3),
    """, newest AS (SELECT DISTINCT point_id, session_date, group_id, result FROM point WHERE result = 'P' ORDER BY session_date DESC, point_id LIMIT 3)
SELECT newest.*, l_linenumber AS ord, s_nationkey AS voter, l_returnflag AS direction FROM newest LEFT JOIN line ON l_orderkey = point_id""",
)
_register(
    "unanimous", QuerySpec("count", unanimous=("A", "N", "R")),
    "SELECT count(DISTINCT point_id) AS n FROM point WHERE EXISTS (SELECT 1 FROM line WHERE l_orderkey = point_id AND l_returnflag = 'A') AND NOT EXISTS (SELECT 1 FROM line WHERE l_orderkey = point_id AND l_returnflag IN ('N', 'R'))",
)
_register(
    "group_votes", QuerySpec("group_votes", voters=(1, 2, 3), themes=(1001,)),
    """SELECT s_nationkey AS group_id, l_returnflag AS direction, count(DISTINCT l_orderkey) AS n FROM line
WHERE s_nationkey IN (1, 2, 3) AND l_orderkey IN (SELECT point_id FROM point WHERE EXISTS (SELECT 1 FROM line AS t JOIN nation ON t.s_nationkey = n_nationkey WHERE t.l_orderkey = point_id AND n_regionkey = 1)) GROUP BY 1, 2""",
)
_register("person_votes", QuerySpec("person_votes", direction="R", years=(1997, 1999)), "SELECT l_suppkey AS person_id, l_returnflag AS direction, count(DISTINCT l_orderkey) AS n FROM line JOIN point ON l_orderkey = point_id WHERE l_returnflag = 'R' AND year BETWEEN 1997 AND 1999 GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
_register("rank_signers", QuerySpec("rank_signers", groups=("MACHINERY",)), "SELECT l_suppkey AS person_id, count(DISTINCT l_orderkey) AS n FROM line JOIN point ON l_orderkey = point_id WHERE l_linenumber = 1 AND group_id = 'MACHINERY' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
_register("group_year", QuerySpec("group_year", results=("F",)), "SELECT group_id, year, count(DISTINCT point_id) AS n FROM point WHERE result = 'F' GROUP BY 1, 2")
_AMENDED = ", own AS (SELECT DISTINCT l_orderkey AS point_id, s_nationkey AS group_id FROM line WHERE l_linestatus = 'F' AND l_orderkey IN (SELECT point_id FROM point))"
_register("coauthorship", QuerySpec("coauthors"), _AMENDED + " SELECT a.group_id AS one, b.group_id AS other, count(DISTINCT point_id) AS n FROM own AS a JOIN own AS b USING (point_id) WHERE a.group_id < b.group_id GROUP BY 1, 2")
_DISTINCT_LINES = "(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_nationkey FROM line WHERE l_linestatus = 'F')"
_register("rank_amendments", QuerySpec("rank_amendments"), f"SELECT s_nationkey AS group_id, count(*) AS n FROM {_DISTINCT_LINES} JOIN point ON l_orderkey = point_id GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
_register("count_amendments", QuerySpec("count_amendments", voters=(4,), years=(1998, 1998)), f"SELECT count(*) AS n FROM {_DISTINCT_LINES} JOIN point ON l_orderkey = point_id WHERE s_nationkey = 4 AND year = 1998")
_THEMES = "SELECT s_nationkey AS theme_id, count(DISTINCT point_id) AS n FROM point JOIN line ON l_orderkey = point_id WHERE year = 1999 GROUP BY 1"
_register("theme_extreme", QuerySpec("theme_extreme", direction="most", years=(1999, 1999)), f"{_THEMES} ORDER BY n DESC, 1 LIMIT 1")
_register("theme_least", QuerySpec("theme_extreme", direction="least", years=(1999, 1999)), f"{_THEMES} ORDER BY n, 1 LIMIT 1")
_register("session_types", QuerySpec("sessions", years=(1996, 2000)), _SESSION + " SELECT type, count(DISTINCT session_date) AS n FROM session WHERE year(session_date) BETWEEN 1996 AND 2000 GROUP BY 1")
_register(
    "first_session", QuerySpec("first_session", years=(1998, 1998)),
    _SESSION + ", f AS (SELECT * FROM session WHERE year(session_date) = 1998 ORDER BY session_date, type LIMIT 1) SELECT session_date, type, point_id, title FROM f LEFT JOIN point USING (session_date)",
)
_register("speaker_counts", QuerySpec("rank_speaker"), "SELECT role AS speaker, count(DISTINCT conv_id * 1000 + turn) AS n FROM conversations WHERE role IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
_register("speech_groups", QuerySpec("rank_group_speeches"), "SELECT role AS group_id, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY 1")
_register("speech_count", QuerySpec("count_speeches", voters=("assistant",)), "SELECT count(*) AS n FROM conversations WHERE role = 'assistant'")
_register(
    "debate_contents", QuerySpec("contents"),
    """, newest AS (SELECT DISTINCT point_id, session_date, group_id, result FROM point ORDER BY session_date DESC, point_id LIMIT 8)
SELECT newest.*, turn AS ord, role AS speaker, text AS summary FROM newest LEFT JOIN conversations ON conv_id = point_id ORDER BY session_date DESC, point_id, turn LIMIT 60""",
)


@query(
    "last_time",
    _POINT
    + """, tagged AS (
  SELECT DISTINCT point_id, session_date, group_id, result, CASE WHEN group_id = 'BUILDING' THEN 'treats' ELSE 'mentions' END AS relation FROM point WHERE amount > 400000
), ranked AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY session_date DESC, point_id) AS k FROM tagged)
SELECT point_id, session_date, group_id, result, relation FROM ranked WHERE k <= 3""",
)
def last_time(spark, folder):
    facts = star_schema_facts(spark, folder)
    hits = facts.points({"group_id"}).where("amount > 400000").select("point_id", F.when(F.col("group_id") == "BUILDING", "treats").otherwise("mentions").alias("relation"))
    return compiled(QuerySpec("last", subject=True), facts, hits)


@query(
    "unanimous_points",
    """SELECT l_orderkey AS point_id FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'A')""",
)
def unanimous_points(spark, folder):
    return unanimous(star_schema_facts(spark, folder).group_vote, "A", "N", "R")


@query(
    "approved_group_year",
    _POINT + "SELECT group_id, year, count(DISTINCT point_id) AS total, count(DISTINCT CASE WHEN result = 'F' THEN point_id END) AS approved FROM point WHERE year BETWEEN 1996 AND 1999 GROUP BY 1, 2",
)
def approved_group_year(spark, folder):
    points = selected(QuerySpec("count", years=(1996, 1999)), star_schema_facts(spark, folder), "group_id")
    return points.groupBy("group_id", "year").agg(F.count_distinct("point_id").alias("total"), F.count_distinct(F.when(F.col("result") == "F", F.col("point_id"))).alias("approved"))
