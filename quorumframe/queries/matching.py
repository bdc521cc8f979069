"""Labels in texts, subjects, ranges, counts, aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.operators import matching
from quorumframe.operators.automaton import folded_words, labels_in
from quorumframe.registry import query, read
from quorumframe.storage import spread

_FOLDED = "lower(translate(text, 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY'))"
_WORDS = f"regexp_extract_all({_FOLDED}, '[a-z0-9]+')"
_SAID = f"' ' || array_to_string({_WORDS}, ' ') || ' '"
_PLACES = ((1, "apache license"), (2, "Versión"), (3, "general public license"), (4, "the"), (5, "públic"), (6, "public license version"))
_VALUES = "(1, 'apache license'), (2, 'version'), (3, 'general public license'), (4, 'the'), (5, 'public'), (6, 'public license version')"


def _texts(spark, folder):
    return spread(read(spark, folder, "documents").select("doc_id", "text")), spark.createDataFrame(list(_PLACES), "place_id int, name string")


@query("gazetteer_hits", f"WITH p(place_id, label) AS (VALUES {_VALUES}) SELECT DISTINCT doc_id, place_id, label FROM (SELECT doc_id, {_SAID} AS said FROM documents) JOIN p ON contains(said, ' ' || label || ' ')")
def gazetteer_hits(spark, folder):
    texts, places = _texts(spark, folder)
    return matching.contained_labels(texts, "doc_id", "text", places, "place_id", "name")


@query(
    "labels_from_texts",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[a-z0-9]+') AS w FROM documents), t AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS said FROM w),
l AS (SELECT DISTINCT unnest([array_to_string(w[1:3], ' '), array_to_string(w[-4:], ' '), array_to_string(w[5:6], ' ')]) AS label FROM w)
SELECT label, count(*) AS n, min(doc_id) AS first FROM l JOIN t ON label <> '' AND contains(said, ' ' || label || ' ') GROUP BY 1""",
)
def labels_from_texts(spark, folder):
    """Three labels from each document, looked for in all: labels grow with the texts."""
    docs = spread(read(spark, folder, "documents").select("doc_id", "text"))
    words = folded_words("text")
    own = F.array(F.slice(words, 1, 3), F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), F.lit(4)), F.slice(words, 5, 2))
    labels = docs.select(F.explode(F.transform(own, lambda w: F.array_join(w, " "))).alias("name")).distinct().withColumn("id", F.col("name"))
    return labels_in(docs, "doc_id", "text", labels, "id", "name").groupBy("label").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(
    "theme_of_label",
    f"""WITH p(place_id, label) AS (VALUES {_VALUES}), h AS (SELECT DISTINCT doc_id, place_id, label FROM (SELECT doc_id, {_SAID} AS said FROM documents) JOIN p ON contains(said, ' ' || label || ' ') WHERE length(label) >= 5 OR said = ' ' || label || ' ')
SELECT doc_id, place_id, label FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(label) DESC, place_id) = 1""",
)
def theme_of_label(spark, folder):
    texts, places = _texts(spark, folder)
    return matching.best_label(texts, "doc_id", "text", places, "place_id", "name")


@query(
    "subject_hits",
    f"""WITH f AS (SELECT doc_id AS point_id, {_WORDS.replace("text", "left(text, 200)")} AS w, true AS is_about FROM documents UNION ALL SELECT doc_id, {_WORDS}, false FROM documents),
s AS (SELECT point_id, is_about, list_transform(w, lambda x: CASE WHEN length(x) > 5 THEN regexp_replace(x, '(es|as|os|s|a|o|e)$', '') ELSE x END) AS stems FROM f),
h AS (SELECT point_id, is_about FROM s WHERE (list_contains(stems, 'licens') AND list_contains(stems, 'public')) OR list_contains(stems, 'apach'))
SELECT point_id, CASE WHEN bool_or(is_about) THEN 'treats' ELSE 'mentions' END AS relation FROM h GROUP BY 1""",
)
def subject_hits(spark, folder):
    docs = spread(read(spark, folder, "documents").select("doc_id", "text"))
    about = docs.select(F.col("doc_id").alias("point_id"), F.substring("text", 1, 200).alias("text"), F.lit(True).alias("is_about"))
    fields = about.unionByName(docs.select(F.col("doc_id").alias("point_id"), "text", F.lit(False).alias("is_about")))
    return matching.subject_hits(fields, [["licens", "public"], ["apach"]])


@query(
    "page_containment",
    """WITH p AS (SELECT o_custkey AS pdf, o_orderkey AS point, o_orderkey % 40 AS page FROM orders), r AS (SELECT o_custkey AS pdf, o_orderkey % 40 AS a, o_orderkey % 40 + o_orderkey % 9 AS b, o_orderkey AS target FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT pdf, point, page, a, target FROM p JOIN r USING (pdf) WHERE page BETWEEN a AND b QUALIFY a = max(a) OVER (PARTITION BY pdf, point, page))
SELECT pdf, point, page, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target FROM m GROUP BY 1, 2, 3""",
)
def page_containment(spark, folder):
    orders = read(spark, folder, "orders").select(F.col("o_custkey").alias("pdf"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 40).alias("page"))
    ranges = orders.where("key % 2 = 0").select("pdf", F.col("page").alias("a"), (F.col("page") + F.col("key") % 9).alias("b"), F.col("key").alias("target"))
    return matching.contained_in_range(orders.withColumnRenamed("key", "point"), ranges, ["pdf"], "page", "a", "b", "target")


@query(
    "tally_match",
    """WITH v AS (SELECT l_suppkey AS point, l_orderkey AS vote, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS f, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS c, min(l_linestatus) AS s FROM lineitem GROUP BY 1, 2),
m AS (SELECT a.point, a.vote AS list_id, b.vote AS tally_id FROM v AS a JOIN v AS b ON a.point = b.point AND a.f = b.f AND a.c = b.c WHERE a.s = 'F' AND b.s = 'O')
SELECT point, list_id, min(tally_id) AS tally_id FROM m GROUP BY 1, 2 HAVING count(DISTINCT tally_id) = 1""",
)
def tally_match(spark, folder):
    votes = read(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("point"), F.col("l_orderkey").alias("vote")).agg(F.count_if(F.col("l_returnflag") == "A").alias("f"), F.count_if(F.col("l_returnflag") == "R").alias("c"), F.min("l_linestatus").alias("s"))
    lists = votes.where("s = 'F'").select("point", "f", "c", F.col("vote").alias("list_id"))
    tallies = votes.where("s = 'O'").select("point", "f", "c", F.col("vote").alias("tally_id"))
    return matching.matching_counts(lists, tallies, "point", ["f", "c"], "list_id", "tally_id")


@query(
    "unified_keys",
    """WITH k AS (SELECT DISTINCT lower(p_name) AS name FROM part), n AS (SELECT split_part(name, ' ', 1) AS head, min_by(name, (length(name), name)) AS named FROM k GROUP BY 1)
SELECT name, CASE WHEN length(head) >= 5 AND head <> 'small' THEN named ELSE name END AS unified FROM k JOIN n ON head = split_part(name, ' ', 1)""",
)
def unified_keys(spark, folder):
    return matching.unified_keys(read(spark, folder, "part").select(F.lower("p_name").alias("name")), "name", common=("small",))


@query("alias_redirect", "SELECT l_orderkey, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 5 = 1 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) THEN l_orderkey - 1 ELSE l_orderkey END AS l_orderkey FROM lineitem) GROUP BY 1")
def alias_redirect(spark, folder):
    aliases = read(spark, folder, "orders").where("o_orderkey % 5 = 1").select(F.col("o_orderkey").alias("old"), (F.col("o_orderkey") - 1).alias("new"))
    return matching.redirected(read(spark, folder, "lineitem").select("l_orderkey"), "l_orderkey", aliases, "old", "new").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "interrupted_segments",
    """WITH s AS (SELECT source, doc_id AS number FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT source, number, lead(number) OVER (PARTITION BY source ORDER BY number) AS next FROM s)
SELECT source, number AS at, number, next FROM n WHERE EXISTS (SELECT 1 FROM documents AS d WHERE d.source = n.source AND d.doc_id > n.number AND d.doc_id < n.next)""",
)
def interrupted_segments(spark, folder):
    known = read(spark, folder, "documents").select("source", F.col("doc_id").alias("number"))
    return matching.interrupted(known.where("number % 3 <> 0").withColumn("at", F.col("number")), ["source"], "at", "number", known)


@query(
    "rank_rescue",
    """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS x, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS y FROM part)
SELECT p_partkey, least(CASE WHEN x <= 20 THEN x END, CASE WHEN y <= 20 THEN y END) AS place FROM a WHERE x <= 20 OR y <= 20""",
)
def rank_rescue(spark, folder):
    return matching.rescued(read(spark, folder, "part"), ["p_retailprice", "p_size"], 20, "p_partkey")
