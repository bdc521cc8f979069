"""What changes in derived tables when their sources do, and votes that are put right."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.operators.closure import closure_change
from quorumframe.plans import nominal
from quorumframe.registry import query, read


@query(
    "closure_change",
    """WITH RECURSIVE link AS (SELECT o_orderkey AS c, o_orderkey // 2 AS p FROM orders WHERE o_orderkey > 0),
after AS (SELECT c, p FROM link JOIN orders ON o_orderkey = c WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_custkey < o_orderkey),
a(c, p) AS (SELECT c, p FROM link UNION SELECT a.c, link.p FROM a JOIN link ON a.p = link.c),
b(c, p) AS (SELECT c, p FROM after UNION SELECT b.c, after.p FROM b JOIN after ON b.p = after.c)
SELECT 'gone' AS kind, c AS child, p AS parent FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'new', c, p FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def closure_of_changed_links(spark, folder):
    """Each order is below the one of half its key. Links of some pending orders go, others get one to the order of their customer's number."""
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    child = F.col("o_orderkey").alias("child")
    half = F.floor(F.col("o_orderkey") / 2).alias("parent")
    links = orders.where("o_orderkey > 0").select(child, half)
    removed = orders.where("o_orderstatus = 'P' and o_orderpriority = '5-LOW' and o_orderkey > 0").select(child, half)
    added = orders.where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT' and o_custkey < o_orderkey").select(child, F.col("o_custkey").alias("parent"))
    new, gone = closure_change(None, links, added=added, removed=removed)
    return gone.select(F.lit("gone").alias("kind"), "child", "parent").unionByName(new.select(F.lit("new").alias("kind"), "child", "parent"))


_TOLD = """v AS (SELECT l_suppkey AS point_id, l_orderkey * 10 + l_linenumber AS vote, CAST(l_quantity AS INTEGER) AS n, l_linestatus AS s, l_returnflag AS r FROM lineitem),
own AS (SELECT row_number() OVER () AS k, point_id, vote, n AS c, CASE WHEN r = 'R' THEN 0 ELSE n // 2 END AS favour, n // 3 AS against, n - n // 2 - n // 3 AS abstain FROM v WHERE s = 'F'),
told AS (SELECT DISTINCT point_id, n AS c, n // 2 - CASE WHEN vote % 7 = 0 AND n > 5 THEN 1 ELSE 0 END AS favour, n // 3 AS against, n - n // 2 - n // 3 + CASE WHEN vote % 7 = 0 AND n > 5 THEN 1 ELSE 0 END AS abstain FROM v WHERE s = 'O')"""


@query(
    "votes_put_right",
    f"""WITH {_TOLD},
m AS (SELECT own.k, told.favour, told.against, told.abstain FROM own JOIN told USING (point_id, c) WHERE own.favour + own.against + own.abstain <> own.c AND own.favour IN (0, told.favour) AND own.against IN (0, told.against) AND own.abstain IN (0, told.abstain)),
one AS (SELECT k, min(favour) AS f, min(against) AS g, min(abstain) AS b FROM m GROUP BY 1 HAVING count(*) = 1)
SELECT vote, coalesce(f, favour) AS favour, coalesce(g, against) AS against, coalesce(b, abstain) AS abstain, f IS NOT NULL AS corrected FROM own LEFT JOIN one USING (k)""",
)
def votes_put_right(spark, folder):
    """Votes whose counts do not add up take those of the one telling of their point that does and agrees."""
    lines = read(spark, folder, "lineitem").select(F.col("l_suppkey").alias("point_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vote"), F.col("l_quantity").cast("int").alias("cast"), "l_linestatus", "l_returnflag")
    half, third = F.floor(F.col("cast") / 2).cast("int"), F.floor(F.col("cast") / 3).cast("int")
    votes = lines.where("l_linestatus = 'F'").select("point_id", "vote", "cast", F.when(F.col("l_returnflag") == "R", 0).otherwise(half).alias("favour"), third.alias("against"), (F.col("cast") - half - third).alias("abstain"))
    other = F.when((F.col("vote") % 7 == 0) & (F.col("cast") > 5), 1).otherwise(0)
    told = lines.where("l_linestatus = 'O'").select("point_id", "cast", (half - other).alias("favour"), third.alias("against"), (F.col("cast") - half - third + other).alias("abstain"))
    return nominal.corrected_counts(votes, told).select("vote", "favour", "against", "abstain", "corrected")
