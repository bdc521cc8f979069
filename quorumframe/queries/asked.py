"""Questions in prose over the tables, and readings of single columns: dates, periods, sessions, candidates, lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quorumframe.functions import passages, questions
from quorumframe.functions.agenda import agenda_number, topic_prefix
from quorumframe.operators import groups, joins, matching
from quorumframe.plans.facts import star_schema_facts
from quorumframe.plans.questions import analysed, sessions_of, spec_of, themes_of
from quorumframe.plans.spec import compiled
from quorumframe.registry import query, read


def _asked_orders(spark, folder):
    """A question for each order, of a kind that its key tells, about the day it was placed on."""
    day, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 8
    month = F.element_at(F.array(*map(F.lit, questions.MONTHS)), F.month(day))
    texts = (
        F.concat(F.lit("¿Qué se aprobó en el pleno del "), F.dayofmonth(day), F.lit(" de "), month, F.lit(" de "), F.year(day), F.lit("?")),
        F.concat(F.lit("el pleno del "), F.date_format(day, "d/M/yyyy")),
        F.concat(F.lit("las mociones de "), F.initcap(month), F.lit(" de "), F.year(day)),
        F.concat(F.lit("entre "), F.year(day), F.lit(" y "), F.year(day) + 2),
        F.concat(F.lit("desde "), F.year(day)),
        F.concat(F.lit("los presupuestos municipales de "), F.year(day)),
        F.concat(F.lit("por mayoría en "), F.year(day)),
        F.concat(F.lit("el número "), F.col("o_orderkey") + 3000),
    )
    text = F.when(kind == 0, texts[0])
    for k, t in enumerate(texts[1:], 1):
        text = text.when(kind == k, t)
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("question_id"), text.alias("question"))


@query(
    "question_periods",
    """WITH o AS (SELECT o_orderkey AS question_id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 8 AS k, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
SELECT question_id, CASE WHEN k IN (0, 1) THEN d END AS day, CASE WHEN k IN (0, 2) THEN CAST(month(d) AS VARCHAR) ELSE '' END AS months,
       CASE WHEN k IN (5, 7) THEN NULL ELSE y END AS since, CASE WHEN k IN (5, 7) THEN NULL WHEN k = 3 THEN y + 2 WHEN k = 4 THEN 2001 ELSE y END AS until, CASE WHEN k = 5 THEN y END AS fiscal FROM o""",
)
def question_periods(spark, folder):
    """What questions written from dates say of dates, read back from their words."""
    months = F.array_join(F.transform(questions.months_of("question"), lambda m: m.cast("string")), ",")
    read_ = _asked_orders(spark, folder).select("question_id", questions.day_of("question").alias("day"), months.alias("months"), questions.period_of("question", 1995, 2001).alias("p"))
    return read_.select("question_id", "day", "months", "p.since", "p.until", "p.fiscal")


@query(
    "question_sessions",
    """WITH o AS (SELECT o_orderkey AS question_id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 8 AS k, year(o_orderdate) AS y FROM orders),
s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session_date FROM orders WHERE (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') OR day(o_orderdate) <= 10),
m AS (SELECT question_id, session_date, d, k FROM o JOIN s ON (k IN (0, 1, 2) AND year(session_date) = y AND month(session_date) = month(d)) OR (k IN (3, 4, 5, 6) AND year(session_date) = y) OR (k = 5 AND year(session_date) = y - 1 AND month(session_date) >= 10))
SELECT question_id, session_date FROM m QUALIFY k NOT IN (0, 1) OR session_date = d OR NOT bool_or(session_date = d) OVER (PARTITION BY question_id)""",
)
def question_sessions(spark, folder):
    """All sessions of all questions, held in the first ten days of a month and on days of urgent pending orders: a day without one means its month."""
    day = F.to_date("o_orderdate")
    sessions = read(spark, folder, "orders").where("(o_orderpriority = '1-URGENT' and o_orderstatus = 'P') or day(o_orderdate) <= 10").select(day.alias("session_date"))
    return sessions_of(_asked_orders(spark, folder), sessions, first_year=1995, last_year=2001)


_QUESTIONS = (
    (1, "¿Cuántas proposiciones sobre NATION_7 se presentaron entre 1996 y 1998?"),
    (2, "¿Cuántas mociones sobre EUROPE se aprobaron en marzo de 1997?"),
    (3, "¿Cuántas proposiciones se rechazaron en 1999?"),
)


@query(
    "answered_questions",
    """SELECT 1 AS question_id, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 7 AND year(o_orderdate) BETWEEN 1996 AND 1998
UNION ALL SELECT 2, count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'EUROPE' AND year(o_orderdate) = 1997 AND month(o_orderdate) = 3 AND o_orderstatus IN ('F', 'P')
UNION ALL SELECT 3, count(DISTINCT o_orderkey) FROM orders WHERE year(o_orderdate) = 1999 AND o_orderstatus = 'O'""",
)
def answered_questions(spark, folder):
    """Questions in prose, each read into a specification and answered from the tables."""
    facts = star_schema_facts(spark, folder)
    asked = spark.createDataFrame(list(_QUESTIONS), "question_id int, question string")
    answers = None
    for row in analysed(asked, facts.theme, first_year=1995, last_year=2001).orderBy("question_id").collect():  # the questions asked
        answer = compiled(spec_of(row, results={"aprobada": ("F", "P"), "rechazada": ("O",)}), facts).select(F.lit(row["question_id"]).alias("question_id"), "n")
        answers = answer if answers is None else answers.unionByName(answer)
    return answers


@query(
    "question_themes",
    """WITH q AS (SELECT p_partkey AS question_id, ' ' || lower(p_name) || ' nation ' || (p_partkey % 40) || ' africa ' || ' ' AS t FROM part),
l AS (SELECT n_nationkey AS theme_id, 'nation ' || n_nationkey AS label FROM nation UNION ALL SELECT r_regionkey + 1000, lower(r_name) FROM region)
SELECT question_id, string_agg(CAST(theme_id AS VARCHAR), ',' ORDER BY theme_id) AS themes FROM q JOIN l ON contains(t, ' ' || label || ' ') GROUP BY 1""",
)
def question_themes(spark, folder):
    text = F.concat_ws(" ", "p_name", F.concat(F.lit("NATION_"), F.col("p_partkey") % 40), F.lit("África"))
    asked = read(spark, folder, "part").select(F.col("p_partkey").alias("question_id"), text.alias("question"))
    found = themes_of(asked, star_schema_facts(spark, folder).theme.select("theme_id", "label"))
    return found.select("question_id", F.array_join(F.transform("themes", lambda t: t.cast("string")), ",").alias("themes"))


@query("last_known_values", "SELECT conv_id, max_by(CASE WHEN turn % 2 = 0 THEN role END, turn) FILTER (WHERE turn % 2 = 0 AND role IS NOT NULL) AS role, max_by(text, turn) FILTER (WHERE text IS NOT NULL) AS text FROM conversations GROUP BY 1")
def last_known_values(spark, folder):
    turns = read(spark, folder, "conversations").withColumn("role", F.when(F.col("turn") % 2 == 0, F.col("role")))
    return groups.last_known(turns, ["conv_id"], ["role", "text"], "turn")


@query(
    "fullest_tally",
    """WITH t AS (SELECT l_suppkey AS point, l_orderkey * 10 + l_linenumber AS tally, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS favour, CASE WHEN l_linestatus = 'F' THEN l_tax END AS against, CASE WHEN l_discount > 0.05 THEN l_discount END AS abstain FROM lineitem)
SELECT point, tally, favour, against, abstain FROM t QUALIFY row_number() OVER (PARTITION BY point ORDER BY (favour IS NOT NULL)::INT + (against IS NOT NULL)::INT + (abstain IS NOT NULL)::INT DESC, tally) = 1""",
)
def fullest_tally(spark, folder):
    """Each line is a tally of its point: of all of them the one that says most, the first of equal ones."""
    lines = read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("point"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tally"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("favour"), F.when(F.col("l_linestatus") == "F", F.col("l_tax")).alias("against"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("abstain"),
    )
    return groups.fullest(lines, ["point"], ["favour", "against", "abstain"], "tally")


@query(
    "majority_runs",
    """WITH e AS (SELECT event_type AS shape, user_id AS question, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS share FROM events GROUP BY 1, 2)
SELECT 'all' AS arm, shape, count(*) AS n, count(CASE WHEN share > 0.5 THEN 1 END) AS solved FROM e GROUP BY 2""",
)
def majority_runs(spark, folder):
    runs = read(spark, folder, "events").select(F.lit("all").alias("arm"), F.col("event_type").alias("shape"), F.col("user_id").alias("question"), (F.col("value") > 10).alias("ok"))
    return groups.solved_by_majority(runs, ["arm"], "shape", "question", "ok")


@query("never_solved", "SELECT user_id FROM events GROUP BY 1 HAVING NOT coalesce(bool_or(event_type = 'error' AND value > 110), false)")
def never_solved(spark, folder):
    return groups.never_solved(read(spark, folder, "events").select("user_id", ((F.col("event_type") == "error") & (F.col("value") > 110)).alias("ok")), "user_id", "ok")


@query(
    "topic_keys",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 90) || '. Moción ' || o_orderkey ELSE 'Moción  ' || o_orderpriority END AS title FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 90 AS INTEGER) END AS number, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 90 AS VARCHAR) ELSE left(regexp_replace(translate(lower(title), 'ó', 'o'), ' +', ' '), 80) END AS prefix FROM t""",
)
def topic_keys(spark, folder):
    key = F.col("o_orderkey")
    title = F.when(key % 3 == 0, F.concat(key % 90, F.lit(". Moción "), key)).otherwise(F.concat(F.lit("Moción  "), "o_orderpriority"))
    return read(spark, folder, "orders").select("o_orderkey", agenda_number(title).alias("number"), topic_prefix(title).alias("prefix"))


@query(
    "structural_ids",
    """WITH ids AS (SELECT DISTINCT o_custkey AS source, o_orderpriority AS topic, min(o_orderkey) AS id FROM orders GROUP BY 1, 2)
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END, ids.id) AS id FROM orders LEFT JOIN ids ON source = o_custkey AND topic = o_orderpriority""",
)
def structural_ids(spark, folder):
    """An id of one's own, else the one of the same source and topic."""
    orders = read(spark, folder, "orders")
    ids = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("id"))
    rows = orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("own"))
    return joins.with_ids(rows, ids, ["o_custkey", "o_orderpriority"], "own", "id").select("o_orderkey", "id")


@query(
    "relation_types",
    "SELECT DISTINCT o_orderkey AS id, 'point' AS class FROM orders UNION SELECT DISTINCT o_custkey + 10000000, 'person' FROM orders",
)
def relation_types(spark, folder):
    from quorumframe.operators.closure import typed_by_relation

    signed = read(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") + 10_000_000).alias("person"))
    return typed_by_relation(signed, "o_orderkey", "person", "point", "person")


@query(
    "proposal_summaries",
    """SELECT o_orderkey AS point_id, 'Order ' || o_orderkey || ' ' || c_mktsegment || ' ' || string_agg(theme, ' ' ORDER BY theme) AS text FROM orders JOIN customer ON o_custkey = c_custkey
JOIN (SELECT l_orderkey, theme FROM (SELECT DISTINCT l_orderkey, 'NATION_' || s_nationkey AS theme FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY theme) <= 6) ON l_orderkey = o_orderkey
WHERE o_orderpriority NOT LIKE '%LOW' GROUP BY o_orderkey, c_mktsegment""",
)
def proposal_summaries(spark, folder):
    """A text for each proposition to be found by: title, group and at most six themes."""
    from quorumframe.plans.retrieval import summaries

    facts = star_schema_facts(spark, folder)
    points = facts.propositions({"title", "group_id"}).where(~F.col("point_type").endswith("LOW"))
    themes = facts.point_theme.join(facts.theme.select("theme_id", "label"), "theme_id")
    return summaries(points, themes)


@query("shown_shares", "SELECT event_type, printf('%.1f', 100.0 * count(CASE WHEN value > 10 THEN 1 END) / count(*)) || '%' AS share FROM events GROUP BY 1")
def shown_shares(spark, folder):
    share = 100.0 * F.count_if(F.col("value") > 10) / F.count("*")
    return read(spark, folder, "events").groupBy("event_type").agg(share.alias("s")).select("event_type", passages.percent_text("s").alias("share"))


@query(
    "sources_to_blocks",
    """WITH RECURSIVE p AS (SELECT o_custkey AS answer, o_orderkey AS block, l_partkey AS source, max(round((l_quantity % 10) / 10, 1)) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
q AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY score DESC, block, source) AS k FROM p WHERE score >= 0.34),
w AS (SELECT answer, 0::BIGINT AS k, []::BIGINT[] AS blocks, []::BIGINT[] AS sources, NULL::BIGINT AS block, NULL::BIGINT AS source, false AS kept FROM (SELECT DISTINCT answer FROM q)
  UNION ALL SELECT w.answer, q.k, CASE WHEN list_contains(blocks, q.block) OR list_contains(sources, q.source) THEN blocks ELSE list_append(blocks, q.block) END,
  CASE WHEN list_contains(blocks, q.block) OR list_contains(sources, q.source) THEN sources ELSE list_append(sources, q.source) END, q.block, q.source, NOT (list_contains(blocks, q.block) OR list_contains(sources, q.source))
  FROM w JOIN q ON q.answer = w.answer AND q.k = w.k + 1)
SELECT answer, block, source FROM w WHERE kept""",
)
def sources_to_blocks(spark, folder):
    """Blocks of an answer with their sources, the best first, none used twice."""
    line = read(spark, folder, "lineitem").join(read(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = line.groupBy(F.col("o_custkey").alias("answer"), F.col("l_orderkey").alias("block"), F.col("l_partkey").alias("source")).agg(F.max(F.round(F.col("l_quantity") % 10 / 10, 1)).alias("score"))
    return matching.matched_once(pairs, "answer", "block", "source", "score").drop("score")


@query(
    "subject_or_theme",
    """WITH h AS (SELECT o_orderkey AS point_id, CASE WHEN o_orderkey % 10 = 7 THEN 'treats' ELSE 'mentions' END AS relation FROM orders WHERE o_orderkey % 10 = 7 OR o_orderpriority = '2-HIGH'),
t AS (SELECT DISTINCT l_orderkey AS point_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 4)
SELECT point_id, max(relation) AS relation FROM (SELECT * FROM h UNION ALL SELECT point_id, 'treats' FROM t) GROUP BY 1""",
)
def subject_or_theme(spark, folder):
    """Points whose fields hold a subject, and those of a theme that stands for it."""
    from quorumframe.plans.questions import hits_or_themes, subject_fields

    facts = star_schema_facts(spark, folder)
    key = F.col("point_id")
    points = facts.point.select("point_id", F.when(key % 10 == 7, "obras en la calle").otherwise("otra cosa").alias("title"))
    entities = facts.point.where("point_type = '2-HIGH'").select("point_id", F.lit("Calle Mayor").alias("label"))
    hits = matching.subject_hits(subject_fields(points, entities=entities), [["calle"]])
    return hits_or_themes(hits, facts.treating([4]))


@query(
    "ambiguous_places",
    """WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size % 3 AS k FROM part),
place AS (SELECT row_number() OVER (ORDER BY name) AS place_id, name FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part)),
held AS (
  SELECT p_partkey, a AS name, k = 0 AS written FROM p UNION ALL
  SELECT p_partkey, b, k = 1 FROM p)
SELECT DISTINCT p_partkey, place_id FROM held JOIN place USING (name) WHERE written OR name NOT IN ('red', 'blue', 'new', 'bolt', 'ring', 'rod')""",
)
def ambiguous_places(spark, folder):
    """The words of all names of parts are places; some are common words as well, and count where a text writes them with a capital within a sentence."""
    a, b, kind = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_size") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("Obras en "), F.initcap(a), F.lit(" y en la "), b))
        .when(kind == 1, F.concat(F.initcap(a), F.lit(" es, según "), F.initcap(b), F.lit(", lo mismo")))  # a capital that opens the sentence
        .otherwise(F.concat(F.lit("una "), a, F.lit(" de "), b))
    )
    parts = read(spark, folder, "part")
    names = parts.select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    places = names.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("place_id"), F.initcap("name").alias("name"))  # words of names
    return matching.places_in(parts.select("p_partkey", text.alias("text")), "p_partkey", "text", places, capitals=["red", "blue", "new", "bolt", "ring", "rod"])


@query(
    "metadata_by_title",
    """WITH m AS (SELECT strftime(o_orderdate, '%d-%m-%Y') || '||' || lower(o_orderpriority) AS k, max_by(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT o_orderkey, status FROM orders LEFT JOIN m ON k = strftime(o_orderdate, '%d-%m-%Y') || '||' || lower(o_orderpriority)""",
)
def metadata_by_title(spark, folder):
    """Metadata that meets fragments by date and the beginning of the folded title; the last of equal keys counts."""
    orders = read(spark, folder, "orders").select("o_orderkey", "o_orderstatus", joins.dated_key(F.date_format("o_orderdate", "dd-MM-yyyy"), "o_orderpriority").alias("key"))
    patches = orders.where("o_orderkey % 2 = 0").select("key", F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    return joins.patched(orders.select("o_orderkey", "key"), patches, "key", "at").select("o_orderkey", "status")


@query("mayor_speeches", "SELECT count(DISTINCT conv_id * 1000 + turn) AS n FROM conversations WHERE role = 'system'")
def mayor_speeches(spark, folder):
    from quorumframe.plans.spec import QuerySpec

    return compiled(QuerySpec("count_speeches", speakers=("system",)), star_schema_facts(spark, folder))


@query(
    "page_tables",
    r"""WITH r AS (SELECT page_id, regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1) AS items FROM pages) SELECT page_id, len(items) AS n FROM r WHERE len(items) > 0""".replace("\\\\", "\\"),
)
def page_tables(spark, folder):
    """Rows of tables, where the lists of the pages are written as tables."""
    from quorumframe.functions.links import page_rows

    pages = read(spark, folder, "pages")
    tabled = pages.select("page_id", F.regexp_replace(F.regexp_replace("html", r"(?i)<li\b([^>]*)>", "<tr><td$1>"), r"(?i)</li>", "</td></tr>").alias("html"))
    return page_rows(tabled).groupBy("page_id").agg(F.count("*").alias("n"))
