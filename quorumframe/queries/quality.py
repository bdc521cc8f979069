"""Constraints, and the streaming operators run over a finished stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.plans import quality
from quorumframe.registry import query, read
from quorumframe.streaming import events as streams


@query(
    "constraint_violations",
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, unnest(list_filter([CASE WHEN NOT o_totalprice >= 50000 THEN 'amount' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'result' END], lambda x: x IS NOT NULL)) AS rule FROM orders""",
)
def constraint_violations(spark, folder):
    return quality.violations(read(spark, folder, "orders"), "o_orderkey", {"amount": F.col("o_totalprice") >= 50000, "result": F.col("o_orderstatus").isin("F", "O")})


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, folder):
    return quality.repeated(read(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dangling_references", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def dangling_references(spark, folder):
    return quality.dangling(read(spark, folder, "documents").select("doc_id"), "doc_id", read(spark, folder, "embeddings"), "vec_id")


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, folder):
    return streams.windowed(read(spark, folder, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
