"""Parts of a retrieval: filters with fallbacks, whole debates, topics, leading blocks and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.plans import retrieval
from quorumframe.registry import query, read
from quorumframe.storage import spread

_FRAGMENT = """fragment AS (SELECT doc_id AS frag_id, DATE '2020-01-01' + CAST(doc_id % 90 AS INTEGER) AS date, CAST(year(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER)) AS INTEGER) AS year, source, lang AS topic, n_chars, text,
  't' || (n_chars % 7) AS theme, ['t' || (n_chars % 5), 't' || (n_chars % 11)] AS themes, CASE WHEN n_chars % 3 > 0 THEN source END AS party FROM documents)"""


def _fragments(spark, folder):
    docs = spread(read(spark, folder, "documents"))
    day = lambda days: F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % days).cast("int"))
    theme = lambda n: F.concat(F.lit("t"), F.col("n_chars") % n)
    return docs.select(
        F.col("doc_id").alias("frag_id"), day(90).alias("date"), F.year(day(1500)).alias("year"), "source", F.col("lang").alias("topic"), "n_chars", "text",
        theme(7).alias("theme"), F.array(theme(5), theme(11)).alias("themes"), F.when(F.col("n_chars") % 3 > 0, F.col("source")).alias("party"), F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("vote_result"),
    )


def _about_sql(party: str, topic: str) -> str:
    return f"""WITH {_FRAGMENT}, themed AS (SELECT * FROM fragment WHERE theme IN ('t1', 't3') OR list_has_any(themes, ['t1', 't3'])),
dated AS (SELECT * FROM themed WHERE date IN (SELECT DATE '2020-01-01' + CAST(s_nationkey * 3 AS INTEGER) FROM supplier)),
own AS (SELECT * FROM dated WHERE coalesce(party = '{party}', false) OR (SELECT count(*) FROM dated WHERE party = '{party}') < 3)
SELECT frag_id, theme, date FROM own WHERE topic LIKE '{topic}%' OR (SELECT count(*) FROM own WHERE topic LIKE '{topic}%') < 1"""


def _about(party: str, topic: str):
    def run(spark, folder):
        dates = read(spark, folder, "supplier").select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s_nationkey") * 3).cast("int")).alias("session_date"))
        found = retrieval.about(_fragments(spark, folder), themes=["t1", "t3"], dates=dates, party=party, topics_=[topic])
        return found.select("frag_id", "theme", "date")

    return run


query("retrieve_about", _about_sql("src1", "e"))(_about("src1", "e"))
query("retrieve_about_nobody", _about_sql("nobody", "zz"))(_about("nobody", "zz"))  # both filters leave too few


@query(
    "retrieve_debates",
    f"""WITH {_FRAGMENT}, chosen AS (SELECT * FROM fragment ORDER BY n_chars DESC, frag_id LIMIT 25)
SELECT frag_id FROM fragment WHERE (date, topic, source) IN (SELECT (date, topic, source) FROM chosen)""",
)
def retrieve_debates(spark, folder):
    """All fragments of the debates that the longest fragments are from."""
    fragments = _fragments(spark, folder)
    chosen = fragments.orderBy(F.desc("n_chars"), "frag_id").limit(25).select("frag_id", F.lit(1).alias("place"))
    return retrieval.debates(fragments, chosen)


@query(
    "retrieve_topics",
    f"""WITH {_FRAGMENT}, t AS (SELECT source AS topic, year, sum(n_chars % 50) * CASE WHEN source = 'src1' THEN 0.2 ELSE 1.0 END AS score FROM fragment GROUP BY 1, 2)
SELECT topic, year, round(score, 6) AS score FROM t WHERE (score >= 0.4 * (SELECT max(score) FROM t) AND score >= 4) OR score >= 500""",
)
def retrieve_topics(spark, folder):
    """Scores by topic and year, a topic that is rarely meant at a fifth; a sum of 500 stays whatever the best."""
    ranked = _fragments(spark, folder).select(F.col("source").alias("topic"), "year", (F.col("n_chars") % 50).alias("score"))
    found = retrieval.topics(ranked, title=500.0, penalty=F.when(F.col("topic") == "src1", 0.2).otherwise(1.0))
    return found.select("topic", "year", F.round("score", 6).alias("score"))


@query(
    "retrieve_leads",
    f"""WITH {_FRAGMENT}, chosen AS (SELECT frag_id, CASE WHEN n_chars % 4 = 0 THEN frag_id END AS lead FROM fragment WHERE theme = 't2' AND n_chars < 900),
block AS (SELECT date, topic, source, min(lead) AS lead, left(string_agg(text, chr(10) ORDER BY text), 3800) AS text FROM fragment JOIN chosen USING (frag_id) GROUP BY 1, 2, 3),
total AS (SELECT *, sum(length(text)) OVER o AS upto, row_number() OVER o AS k FROM block WINDOW o AS (ORDER BY lead NULLS LAST, date, topic, source ROWS UNBOUNDED PRECEDING))
SELECT date, topic, source, md5(text) AS digest FROM total WHERE upto <= 20000 OR k = 1""",
)
def retrieve_leads(spark, folder):
    """Blocks that hold a leading fragment come first, as far as the budget goes."""
    fragments = _fragments(spark, folder)
    chosen = fragments.where("theme = 't2' and n_chars < 900").select("frag_id", F.when(F.col("n_chars") % 4 == 0, F.col("frag_id")).alias("lead"))
    return retrieval.context(fragments, chosen).select("date", "topic", "source", F.md5("text").alias("digest"))


@query(
    "retrieve_citations",
    """WITH r AS (SELECT l_orderkey AS point_id, min(l_partkey * 100000 + l_orderkey) AS pos FROM lineitem GROUP BY 1)
SELECT point_id, CAST(o_orderdate AS DATE) AS date, o_custkey AS page, o_orderpriority AS file, 'Order ' || o_orderkey AS title FROM r JOIN orders ON o_orderkey = point_id ORDER BY pos, point_id LIMIT 15""",
)
def retrieve_citations(spark, folder):
    """The first fifteen orders that lines name, lines being in the order of their parts."""
    rows = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("point_id"), (F.col("l_partkey") * 100_000 + F.col("l_orderkey")).alias("pos"))
    sources = read(spark, folder, "orders").select(F.col("o_orderkey").alias("point_id"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("file"), F.concat(F.lit("Order "), "o_orderkey").alias("title"))
    return retrieval.citations(rows, sources)
