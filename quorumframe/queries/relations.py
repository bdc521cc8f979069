"""Closures, chains, interval and as-of joins, majorities and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.operators import groups, joins
from quorumframe.operators.closure import chained, transitive_closure, typed
from quorumframe.plans.facts import star_schema_facts
from quorumframe.registry import query, read


@query(
    "theme_closure",
    """WITH RECURSIVE up(child, parent) AS (
  SELECT n_nationkey, n_regionkey + 1000 FROM nation UNION SELECT r_regionkey + 1000, 5000 FROM region
), walk(child, parent) AS (SELECT * FROM up UNION SELECT walk.child, up.parent FROM walk JOIN up ON walk.parent = up.child)
SELECT child, parent FROM walk""",
)
def theme_closure(spark, folder):
    nation, region = read(spark, folder, "nation"), read(spark, folder, "region")
    links = nation.select(F.col("n_nationkey").alias("child"), (F.col("n_regionkey") + 1000).alias("parent")).unionByName(region.select((F.col("r_regionkey") + 1000).alias("child"), F.lit(5000).alias("parent")))
    return transitive_closure(links)


@query("rollup_chain", "SELECT DISTINCT l_orderkey AS point_id, n_regionkey AS district FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def rollup_chain(spark, folder):
    treats = star_schema_facts(spark, folder).point_theme
    district = read(spark, folder, "nation").select(F.col("n_nationkey").alias("theme_id"), F.col("n_regionkey").alias("district"))
    return chained(treats, district, "theme_id")


@query("subclass_types", "SELECT s_suppkey AS id, unnest(['councillor', 'person', 'entity']) AS class FROM supplier UNION ALL SELECT c_custkey + 1000000, unnest(['person', 'entity']) FROM customer")
def subclass_types(spark, folder):
    classes = spark.createDataFrame([("councillor", "person"), ("person", "entity"), ("proposition", "point")], "child string, parent string")
    people = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("councillor").alias("class"))
    return typed(people.unionByName(read(spark, folder, "customer").select((F.col("c_custkey") + 1000000).alias("id"), F.lit("person").alias("class"))), classes)


@query(
    "majority_75",
    """WITH c AS (SELECT l_orderkey AS point_id, l_returnflag AS direction, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT point_id, direction FROM c QUALIFY n >= 0.75 * sum(n) OVER (PARTITION BY point_id)""",
)
def majority_75(spark, folder):
    votes = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_returnflag").alias("direction"))
    return groups.majority(votes, ["point_id"], "direction")


@query("decisive_vote", "SELECT l_orderkey AS point_id, l_linenumber AS ord, l_returnflag AS direction FROM lineitem QUALIFY l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey)")
def decisive_vote(spark, folder):
    votes = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("direction"))
    return groups.decisive(votes, ["point_id"], "ord").where("is_decisive").drop("is_decisive")


_PERSON = "person AS (SELECT o_custkey AS person_id, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1)"


@query(
    "active_interval",
    """WITH a AS (
  SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL
  SELECT o_custkey, CAST(l_shipdate AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT person_id, min(d) AS first, max(d) AS last, count(*) AS n FROM a GROUP BY 1""",
)
def active_interval(spark, folder):
    orders = read(spark, folder, "orders")
    placed = orders.select(F.col("o_custkey").alias("person_id"), F.to_date("o_orderdate").alias("d"))
    line = read(spark, folder, "lineitem").select("l_orderkey", "l_shipdate")
    shipped = line.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("person_id"), F.to_date("l_shipdate").alias("d"))
    return groups.active_intervals([placed, shipped], "person_id", "d")


@query(
    "active_at_session",
    f"""WITH {_PERSON}, s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d AS session_date, count(*) AS n FROM s JOIN person ON first <= d AND d <= last GROUP BY 1""",
)
def active_at_session(spark, folder):
    orders = read(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("session_date"))
    people = orders.groupBy("o_custkey").agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    return joins.active_counts(orders, people, "session_date", "first", "last")


_NAMED = f"""WITH {_PERSON}, named AS (SELECT person_id % 997 AS surname, c_mktsegment AS party, person.* FROM person JOIN customer ON person_id = c_custkey)"""


@query(
    "ambiguous_surname",
    f"""{_NAMED}, asked AS (SELECT DISTINCT o_custkey % 997 AS surname, CAST(o_orderdate AS DATE) AS d FROM orders),
m AS (SELECT surname, d, person_id, coalesce(first <= d AND d <= last, false) AS active FROM asked JOIN named USING (surname)),
k AS (SELECT * FROM m QUALIFY active OR NOT bool_or(active) OVER (PARTITION BY surname, d))
SELECT surname, d, CASE WHEN count(DISTINCT person_id) = 1 THEN min(person_id) END AS person_id FROM k GROUP BY 1, 2""",
)
def ambiguous_surname(spark, folder):
    """A surname at a date names the one person active then, or the only one of that name; else nobody."""
    asked, people = _surnames(spark, folder)
    return joins.named_at(asked, people, "surname", "d", "person_id", "first", "last")


@query(
    "hinted_surname",
    f"""{_NAMED}, asked AS (SELECT DISTINCT o_custkey % 997 AS surname, CAST(o_orderdate AS DATE) AS d, CASE o_orderpriority WHEN '1-URGENT' THEN 'BUILDING' WHEN '2-HIGH' THEN 'MACHINERY' END AS party FROM orders),
m AS (SELECT a.surname, a.d, a.party, person_id, CASE WHEN first <= a.d AND a.d <= last THEN 2 ELSE 0 END + CASE WHEN a.party = named.party THEN 1 ELSE 0 END AS level FROM asked AS a JOIN named USING (surname)),
k AS (SELECT * FROM m QUALIFY level = max(level) OVER (PARTITION BY surname, d, party))
SELECT surname, d, party, CASE WHEN count(DISTINCT person_id) = 1 THEN min(person_id) END AS person_id FROM k GROUP BY 1, 2, 3""",
)
def hinted_surname(spark, folder):
    """The same with the party that the text names beside the surname."""
    asked, people = _surnames(spark, folder)
    return joins.named_at(asked, people, "surname", "d", "person_id", "first", "last", hint="party")


def _surnames(spark, folder):
    orders = read(spark, folder, "orders")
    said = F.when(F.col("o_orderpriority") == "1-URGENT", "BUILDING").when(F.col("o_orderpriority") == "2-HIGH", "MACHINERY")
    placed = orders.select(F.col("o_custkey").alias("person_id"), F.to_date("o_orderdate").alias("d"), said.alias("party"))
    party = read(spark, folder, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("party"))
    people = placed.groupBy("person_id").agg(F.min("d").alias("first"), F.max("d").alias("last")).join(party, "person_id")
    surname = (F.col("person_id") % 997).alias("surname")
    return placed.select(surname, "d", "party"), people.select("*", surname)


@query(
    "asof_page",
    """SELECT e.event_id, e.user_id, p.event_id AS page FROM (SELECT * FROM events WHERE event_type <> 'view') AS e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) AS p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def asof_page(spark, folder):
    events = read(spark, folder, "events")
    pages = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("page"))
    return joins.asof_join(events.where("event_type <> 'view'").select("event_id", "user_id", "ts"), pages, ["user_id"], "ts", ["page"]).drop("ts")


@query(
    "legislature_of_date",
    """SELECT o_orderkey AS point_id, term_id FROM orders LEFT JOIN
(VALUES (1, DATE '1995-01-01', DATE '1997-06-15'), (2, DATE '1997-06-15', DATE '1999-06-15'), (3, DATE '1999-06-15', DATE '2003-06-15')) AS term(term_id, a, b)
ON CAST(o_orderdate AS DATE) >= a AND CAST(o_orderdate AS DATE) < b""",
)
def legislature_of_date(spark, folder):
    facts = star_schema_facts(spark, folder)
    points = read(spark, folder, "orders").select(F.col("o_orderkey").alias("point_id"), F.to_date("o_orderdate").alias("d"))
    return joins.interval_join(points, facts.term, "d", "start", "end", closed=False, how="left").select("point_id", "term_id")


@query(
    "nearest_session",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), asked AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS missing FROM lineitem)
SELECT missing, (SELECT max(d) FROM d WHERE d < missing) AS before, (SELECT min(d) FROM d WHERE d > missing) AS after FROM asked""",
)
def nearest_session(spark, folder):
    sessions = read(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d"))
    asked = read(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("missing"))
    return joins.nearest_before_after(sessions, asked, "missing", "d")


@query("anti_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_resume(spark, folder):
    return joins.resume(read(spark, folder, "documents").select("doc_id"), read(spark, folder, "labels"), "doc_id")


@query(
    "metadata_merge",
    "SELECT documents.doc_id, source, CASE WHEN labels.doc_id IS NULL THEN lang WHEN toxic = 1 THEN NULL ELSE 'q' || quality END AS lang FROM documents LEFT JOIN labels USING (doc_id)",
)
def metadata_merge(spark, folder):
    patches = read(spark, folder, "labels").select("doc_id", F.when(F.col("toxic") == 1, None).otherwise(F.concat(F.lit("q"), "quality")).alias("lang"), F.lit(1).alias("at"))
    return joins.patched(read(spark, folder, "documents").select("doc_id", "source", "lang"), patches, "doc_id", "at")


@query(
    "most_common_value",
    """WITH c AS (SELECT c_nationkey AS place_id, c_mktsegment AS party, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1, 2)
SELECT place_id, party FROM c QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY n DESC, first) = 1""",
)
def most_common_value(spark, folder):
    people = read(spark, folder, "customer").select(F.col("c_nationkey").alias("place_id"), F.col("c_mktsegment").alias("party"), "c_custkey")
    return groups.most_common(people, ["place_id"], "party", "c_custkey")


@query(
    "bilingual_dedup",
    """WITH d AS (SELECT doc_id, n_chars % 50 AS number, source, lang FROM documents)
SELECT doc_id, lang FROM d QUALIFY lang = 'es' OR NOT bool_or(lang = 'es') OVER (PARTITION BY source, number)""",
)
def bilingual_dedup(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", (F.col("n_chars") % 50).alias("number"), "source", "lang")
    return groups.without_translated_copies(docs, ["source", "number"], "lang", "es").select("doc_id", "lang")


@query("stats_summary", "SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS spread FROM events GROUP BY 1")
def stats_summary(spark, folder):
    return groups.summary(read(spark, folder, "events"), ["event_type"], "value")


@query(
    "verdict_pivot",
    """SELECT user_id % 10 AS arm, count(*) AS n, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS share_click,
avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS share_error, avg(value) AS mean_latency FROM events GROUP BY 1""",
)
def verdict_pivot(spark, folder):
    return groups.verdicts(read(spark, folder, "events").withColumn("arm", F.col("user_id") % 10), ["arm"], "event_type", ["click", "error"], "value")


@query(
    "row_fusion",
    "SELECT l_orderkey AS p, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS l_returnflag, string_agg(DISTINCT l_linestatus, '; ' ORDER BY l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1",
)
def row_fusion(spark, folder):
    return groups.fused(read(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "p"), "p", ["l_returnflag", "l_linestatus"])


@query("joined_turns", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def joined_turns(spark, folder):
    return groups.joined_text(read(spark, folder, "conversations").where("text is not null"), "conv_id", "turn", "text")


@query("vote_coverage", "SELECT count(*) AS points, count(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 1 END) AS with_votes FROM orders")
def vote_coverage(spark, folder):
    voted = read(spark, folder, "lineitem").select("l_orderkey").distinct().withColumn("has", F.lit(True))
    points = read(spark, folder, "orders").select("o_orderkey").join(voted, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return points.agg(F.count("*").alias("points"), F.count("has").alias("with_votes"))
