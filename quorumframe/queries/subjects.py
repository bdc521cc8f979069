"""Subjects that are relaxed until something is found."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.functions.text import stem, words
from quorumframe.operators.alignment import aligned
from quorumframe.plans import relaxation
from quorumframe.registry import query, read
from quorumframe.storage import spread

_FOLD = "lower(translate(text, 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY'))"
_STEM = "CASE WHEN length(w) > 5 THEN regexp_replace(w, '(es|as|os|s|a|o|e)$', '') ELSE w END"
_HITS = f"""WITH tok AS (SELECT DISTINCT doc_id, {_STEM} AS w FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '[a-z]+')) AS w FROM documents) UNION SELECT doc_id, {_STEM} FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '\\b[0-9]+\\b')) AS w FROM documents)),
item AS (SELECT item_id, unnest(regexp_extract_all({_FOLD}, '[a-z]{{4,}}')[1:4]) AS w FROM benchmark),
asked AS (SELECT DISTINCT item_id, {_STEM} AS w FROM item),
counted AS (SELECT item_id, w, count(doc_id) AS df FROM asked LEFT JOIN tok USING (w) GROUP BY 1, 2),
total AS (SELECT count(*) AS n FROM documents),
step AS (
  SELECT item_id, 0 AS step, w FROM counted UNION ALL
  SELECT item_id, 1, w FROM counted, total WHERE df <= 0.03 * n UNION ALL
  SELECT item_id, 2, w FROM (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY df, w) = 1), total WHERE df <= 0.01 * n),
size AS (SELECT item_id, step, count(*) AS k FROM step GROUP BY 1, 2),
hit AS (SELECT item_id, step, doc_id FROM step JOIN tok USING (w) JOIN size USING (item_id, step) GROUP BY item_id, step, doc_id, k HAVING count(*) = k),
treated AS (SELECT item_id, step, doc_id, lang IN ('es', 'eu') AS treats FROM hit JOIN documents USING (doc_id)),
"""


def _subjects(spark, folder):
    """The first four words of four letters or more of each benchmark item as one alternative."""
    own = F.array_distinct(F.transform(F.slice(words("text", 4), 1, 4), stem))
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), F.array(own).alias("alternatives"))


def _fields(spark, folder):
    return spread(read(spark, folder, "documents").select(F.col("doc_id").alias("point_id"), "text", F.col("lang").isin("es", "eu").alias("is_about")))


@query(
    "relaxed_subjects",
    _HITS
    + """first AS (SELECT * FROM treated QUALIFY step = min(step) OVER (PARTITION BY item_id)),
kept AS (SELECT * FROM first QUALIFY treats = bool_or(treats) OVER (PARTITION BY item_id))
SELECT item_id AS question_id, step, doc_id AS point_id, CASE WHEN treats THEN 'treats' ELSE 'mentions' END AS relation FROM kept""",
)
def relaxed_subjects(spark, folder):
    """All words, then the specific ones, then the rarest: the first step with hits in the documents."""
    return relaxation.relaxed_hits(_subjects(spark, folder), _fields(spark, folder)).drop("criterion")


@query("subject_exists", _HITS + "found AS (SELECT item_id, min(step) AS step FROM treated WHERE step <= 1 GROUP BY 1) SELECT item_id AS question_id, step FROM benchmark LEFT JOIN found USING (item_id)")
def subject_exists(spark, folder):
    return relaxation.subject_exists(_subjects(spark, folder), _fields(spark, folder))


@query(
    "subject_alternatives",
    """WITH p AS (SELECT p_partkey AS question_id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(p_type) AS t, p_partkey % 4 AS k FROM part),
s AS (SELECT *, CASE WHEN length(a) > 5 THEN regexp_replace(a, '(es|as|os|s|a|o|e)$', '') ELSE a END AS sa, CASE WHEN length(b) > 5 THEN regexp_replace(b, '(es|as|os|s|a|o|e)$', '') ELSE b END AS sb, CASE WHEN length(t) > 5 THEN regexp_replace(t, '(es|as|os|s|a|o|e)$', '') ELSE t END AS st FROM p)
SELECT question_id, CASE k
  WHEN 0 THEN array_to_string(list_filter([CASE WHEN length(a) >= 4 THEN sa END, CASE WHEN length(t) >= 4 AND st <> sa THEN st END], lambda x: x IS NOT NULL), ' ') || CASE WHEN length(b) >= 4 OR length(t) >= 4 THEN '|' || array_to_string(list_filter([CASE WHEN length(b) >= 4 THEN sb END, CASE WHEN length(t) >= 4 AND st <> sb THEN st END], lambda x: x IS NOT NULL), ' ') ELSE '' END
  WHEN 1 THEN CASE WHEN length(a) >= 4 THEN sa ELSE '' END
  WHEN 2 THEN array_to_string(list_filter([CASE WHEN length(a) >= 4 THEN sa END, CASE WHEN length(b) >= 4 AND sb <> sa THEN sb END], lambda x: x IS NOT NULL), ' ')
  ELSE '' END AS said FROM s""",
)
def subject_alternatives(spark, folder):
    """Subjects of questions about parts: two with one complement, one with what belongs to it, one until a year, and none."""
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    kind = F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("¿Cuántas mociones sobre el "), a, F.lit(" o la "), b, F.lit(" de "), F.lower("p_type"), F.lit(" se aprobaron?")))
        .when(kind == 1, F.concat(F.lit("¿Qué se dijo acerca de la "), a, F.lit(" y sus "), b, F.lit("?")))
        .when(kind == 2, F.concat(F.lit("propuestas relacionadas con "), a, F.lit(" "), b, F.lit(" en "), F.lit("2019")))
        .otherwise(F.concat(F.lit("¿Qué grupo presentó más de "), a, F.lit("?")))
    )
    asked = read(spark, folder, "part").select(F.col("p_partkey").alias("question_id"), relaxation.alternatives(relaxation.subject_phrase(text)).alias("x"))
    return asked.select("question_id", F.array_join(F.transform("x", lambda ws: F.array_join(ws, " ")), "|").alias("said"))


@query(
    "aligned_turns",
    """WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(lower(translate(text, 'áéíóúñ', 'aeioun')), '[a-z]+')) > 0 AS worded FROM conversations)
SELECT conv_id, count(CASE WHEN worded AND turn % 3 <> 1 THEN 1 END) AS matched, count(*) - count(CASE WHEN worded AND turn % 3 <> 1 THEN 1 END) AS recovered, CAST(count(CASE WHEN worded AND turn % 3 <> 1 THEN 1 END) AS DOUBLE) AS score FROM t GROUP BY 1""",
)
def aligned_turns(spark, folder):
    """Conversations against themselves without every third turn: what is there is matched whole, the rest is placed between."""
    turns = spread(read(spark, folder, "conversations").select("conv_id", F.col("turn").alias("at"), F.array_distinct(words("text")).alias("words")))
    met = aligned(turns, turns.where("at % 3 <> 1"), "conv_id")
    return met.groupBy("conv_id").agg(F.count("other").alias("matched"), F.count_if(F.col("other").isNull()).alias("recovered"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))


@query(
    "known_themes",
    """WITH theme AS (SELECT p_name AS theme_id, replace(p_name, ' ', '') AS s FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
asked AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 't_' || replace(p_name, ' ', '_') || '-' || p_partkey WHEN 1 THEN left(replace(p_name, ' ', '_'), 4) WHEN 2 THEN reverse(p_name) || p_partkey WHEN 3 THEN 'other_' || p_partkey ELSE '' END AS slug FROM part),
one AS (SELECT slug, min(embedding) AS e FROM asked LEFT JOIN embeddings ON vec_id = k GROUP BY slug),
bare AS (SELECT *, replace(replace(replace(slug, '_', ''), '-', ''), ' ', '') AS b FROM one),
near AS (SELECT slug, theme_id FROM bare JOIN theme ON b <> '' AND (contains(b, s) OR starts_with(s, b)) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY NOT contains(b, s), length(s) DESC, s, theme_id) = 1),
proto AS (SELECT label, min_by(embedding, vec_id) AS e FROM embeddings GROUP BY 1),
like_ AS (SELECT slug, label, list_cosine_similarity(one.e::DOUBLE[], proto.e::DOUBLE[]) AS score FROM one, proto WHERE one.e IS NOT NULL),
best AS (SELECT slug, label FROM like_ QUALIFY row_number() OVER (PARTITION BY slug ORDER BY score DESC, CAST(label AS VARCHAR)) = 1 AND score >= 0.7)
SELECT slug, coalesce(theme_id, 'm' || label) AS theme_id, CASE WHEN theme_id IS NOT NULL THEN 'text' WHEN label IS NOT NULL THEN 'meaning' END AS by FROM one LEFT JOIN near USING (slug) LEFT JOIN best USING (slug)""",
)
def known_themes(spark, folder):
    """Names of parts with something before and after them, cut off, or turned round, as themes that somebody made up: by text, else by the vector of their number."""
    parts = read(spark, folder, "part").select("p_partkey", "p_name")
    themes = parts.where("p_partkey % 3 = 0").select(F.col("p_name").alias("theme_id"), F.col("p_name").alias("slug"))
    name, turn = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey") % 5
    made = F.when(turn == 0, F.concat(F.lit("t_"), name, F.lit("-"), "p_partkey")).when(turn == 1, F.substring(name, 1, 4)).when(turn == 2, F.concat(F.reverse("p_name"), "p_partkey")).when(turn == 3, F.concat(F.lit("other_"), "p_partkey")).otherwise("")
    asked = parts.select(made.alias("slug"), "p_partkey")
    every = read(spark, folder, "embeddings")
    vectors = asked.join(every, F.col("p_partkey") == F.col("vec_id")).select("slug", "embedding")
    prototypes = every.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.concat(F.lit("m"), "label").alias("theme_id"), "embedding")
    return relaxation.known_themes(asked, themes, vectors=vectors, prototypes=prototypes)
