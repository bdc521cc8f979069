"""Sampling, filling, runs, diversity, thresholds and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.operators import windows
from quorumframe.registry import query, read


@query(
    "forward_fill",
    """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role END AS speaker, CASE WHEN turn % 2 = 0 THEN 'g' || turn END AS party FROM conversations),
g AS (SELECT *, last_value(CASE WHEN speaker IS NOT NULL THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS src FROM t)
SELECT g.conv_id, g.turn, g.speaker, CASE WHEN src IS NULL THEN g.party ELSE s.party END AS party, s.speaker AS filled
FROM g LEFT JOIN t AS s ON s.conv_id = g.conv_id AND s.turn = g.src""",
)
def forward_fill(spark, folder):
    """The party goes with the speaker it was seen with, so it does not leak to the next one."""
    turns = read(spark, folder, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("speaker"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("g"), "turn")).alias("party"))
    return windows.forward_fill(turns, "speaker", ["conv_id"], ["turn"], into="filled", carry=["party"])


@query(
    "islands_longest",
    """WITH d AS (SELECT source, doc_id, n_chars, doc_id - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS run FROM documents),
r AS (SELECT source, run, sum(n_chars) AS total, min(doc_id) AS first FROM d GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, min(doc_id)) = 1)
SELECT source, doc_id FROM d JOIN r USING (source, run)""",
)
def islands_longest(spark, folder):
    docs = read(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return windows.longest_island(docs, ["source"], "doc_id", F.col("n_chars")).select("source", "doc_id")


@query("first_seen_dedup", "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY left(text, 200), lang")
def first_seen_dedup(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "lang", F.substring("text", 1, 200).alias("opening"))
    return windows.first_seen(docs, ["opening", "lang"], ["doc_id"]).select("doc_id", "lang")


@query(
    "even_sample",
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE n <= 7 OR k IN (SELECT round_even(i * (n - 1) / 6.0, 0) FROM range(7) AS t(i))""",
)
def even_sample(spark, folder):
    return windows.even_sample(read(spark, folder, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 7)


@query("newest_k", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def newest_k(spark, folder):
    orders = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return windows.newest(orders, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 3).drop("o_orderdate")


@query(
    "round_robin",
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT source, doc_id, row_number() OVER (ORDER BY k, source) AS turn FROM r ORDER BY k, source LIMIT 50""",
)
def round_robin(spark, folder):
    docs = read(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return windows.round_robin(docs, "source", [F.desc("n_chars"), "doc_id"], 50).drop("n_chars")


@query(
    "temporal_diversity",
    """WITH t AS (SELECT year(o_orderdate) AS year, o_orderkey, o_totalprice AS score, max(o_totalprice) OVER (PARTITION BY year(o_orderdate)) AS best FROM orders)
SELECT year, o_orderkey, score FROM t WHERE score >= 0.9 * best ORDER BY score DESC, o_orderkey LIMIT 15""",
)
def temporal_diversity(spark, folder):
    orders = read(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", F.col("o_totalprice").alias("score"))
    return windows.temporal_diversity(orders, "year", "score", "o_orderkey")


@query("relative_threshold", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= greatest(0.7 * (SELECT max(p_retailprice) FROM part), 4) OR p_brand = 'Brand#3'")
def relative_threshold(spark, folder):
    parts = read(spark, folder, "part").select("p_partkey", "p_retailprice", "p_brand")
    return windows.relative_threshold(parts, "p_retailprice", share=0.7, override=F.col("p_brand") == "Brand#3").drop("p_brand")


@query(
    "body_chunk",
    """WITH t AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM t WHERE CASE WHEN n > 3 THEN k > 1 AND k <= least(n - 2, 9) ELSE k <= 8 END
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, turn) = 1""",
)
def body_chunk(spark, folder):
    turns = read(spark, folder, "conversations").select("conv_id", "turn", F.char_length("text").alias("size"))
    return windows.body_rows(turns, ["conv_id"], "turn", "size").drop("size")


@query("min_survivor_filter", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 9900 OR (SELECT count(*) FROM supplier WHERE s_acctbal > 9900) < 30")
def min_survivor_filter(spark, folder):
    return windows.filter_unless_few(read(spark, folder, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal") > 9900, 30).drop("s_acctbal")


@query(
    "budget_cut",
    """WITH t AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT source, doc_id FROM t WHERE total <= 7000 OR k = 1""",
)
def budget_cut(spark, folder):
    return windows.char_budget(read(spark, folder, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), 7000).drop("n_chars")


@query(
    "water_fill_cap",
    """WITH caps AS (SELECT unnest(range(600, 3801)) AS cap), s AS (SELECT source, list(n_chars) AS sizes FROM documents GROUP BY 1)
SELECT source, max(CASE WHEN cap = 600 OR list_sum(list_transform(sizes, lambda x: least(x, cap))) <= 90000 THEN cap END) AS cap FROM s, caps GROUP BY 1""",
)
def water_fill_cap(spark, folder):
    return windows.common_cap(read(spark, folder, "documents").select("source", "n_chars"), ["source"], "n_chars", 90_000, 600, 3800)


@query(
    "event_sessions",
    """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, folder):
    events = read(spark, folder, "events").select("user_id", "ts")
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
