"""Ordered computations over whole tables that have no key, or a very large one."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.operators import ordered
from quorumframe.registry import query, read


@query(
    "events_in_order",
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER so_far AS last_purchase,
       CAST(sum(CAST(value * 100 AS BIGINT)) OVER so_far AS BIGINT) AS cents, lag(event_type) OVER (ORDER BY ts, event_id) AS previous
FROM events WINDOW so_far AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def events_in_order(spark, folder):
    """All events as one order: the last purchase, the sum so far and the type of the event before."""
    events = read(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    met = ordered.over_order(
        events, [], ["ts", "event_id"],
        last={"last_purchase": F.when(F.col("event_type") == "purchase", F.col("value"))},
        total={"cents": F.round(F.col("value") * 100).cast("long")},
        previous={"previous": F.col("event_type")},
    )
    return met.select("event_id", "last_purchase", "cents", "previous")


@query(
    "events_filled",
    """WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS k, CASE WHEN event_id % 5 = 0 THEN user_id END AS speaker, CASE WHEN event_id % 2 = 0 THEN event_type END AS party FROM events),
s AS (SELECT *, max(CASE WHEN speaker IS NOT NULL THEN k END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS src FROM e)
SELECT s.event_id, s.speaker, CASE WHEN s.src IS NULL THEN s.party ELSE f.party END AS party, f.speaker AS filled FROM s LEFT JOIN e AS f ON f.k = s.src""",
)
def events_filled(spark, folder):
    events = read(spark, folder, "events").select("event_id", "ts", F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("speaker"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("party"))
    return ordered.filled_forward(events, "speaker", [], ["ts", "event_id"], into="filled", carry=["party"]).drop("ts")


@query(
    "events_asof",
    """SELECT e.event_id, p.event_id AS error_id, p.value AS error_value FROM (SELECT * FROM events WHERE event_type = 'purchase') AS e
ASOF LEFT JOIN (SELECT ts, event_id, value FROM events WHERE event_type = 'error') AS p ON e.ts >= p.ts""",
)
def events_asof(spark, folder):
    """For each purchase the last error of anybody before it."""
    events = read(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    errors = events.where("event_type = 'error'").select("ts", F.col("event_id").alias("error_id"), F.col("value").alias("error_value"))
    return ordered.asof(events.where("event_type = 'purchase'").select("event_id", "ts"), errors, [], "ts", ["error_id", "error_value"]).drop("ts")


@query(
    "documents_longest_run",
    """WITH d AS (SELECT lang, doc_id, n_chars, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS run FROM documents WHERE doc_id % 11 <> 5),
r AS (SELECT lang, run FROM d GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(n_chars) DESC, min(doc_id)) = 1)
SELECT lang, doc_id FROM d JOIN r USING (lang, run)""",
)
def documents_longest_run(spark, folder):
    """Four languages, so each key holds a quarter of all rows."""
    docs = read(spark, folder, "documents").where("doc_id % 11 <> 5").select("lang", "doc_id", "n_chars")
    return ordered.longest_run(docs, ["lang"], "doc_id", F.col("n_chars")).select("lang", "doc_id")


@query(
    "events_bursts",
    """WITH e AS (SELECT event_id, ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM events)
SELECT event_id, CAST(sum(opens) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM e""",
)
def events_bursts(spark, folder):
    """Bursts of events of all users together: a pause of ten minutes ends one."""
    return ordered.sessions(read(spark, folder, "events").select("event_id", "ts"), [], "ts", "event_id", 600).drop("ts")
