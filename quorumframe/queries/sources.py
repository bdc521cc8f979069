"""Tables that go out in a format and come back: taxonomies in Turtle, graphs in triples, rows in JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.registry import query, read
from quorumframe.sources import files
from quorumframe.storage import new_path


@query(
    "turtle_taxonomy",
    """SELECT 'http://q/c' || c_custkey AS theme_id, c_name || '; "' || c_mktsegment || '". x' AS label, 'http://q/n' || c_nationkey AS parent_id, lower(c_mktsegment) AS others FROM customer
UNION ALL SELECT 'http://q/n' || n_nationkey, n_name, 'http://q/r' || n_regionkey, '' FROM nation UNION ALL SELECT 'http://q/r' || r_regionkey, r_name, NULL, '' FROM region""",
)
def turtle_taxonomy(spark, folder):
    """Customers below nations below regions, written as a vocabulary in Turtle with short names and lists, and read again."""
    name = F.concat("c_name", F.lit('; \\"'), "c_mktsegment", F.lit('\\". x'))
    customers = read(spark, folder, "customer").select(F.format_string(':c%d a skos:Concept ; # a "customer"\n  skos:prefLabel "%s"@es, "%s"@eu ;\n  skos:broader :n%d .', "c_custkey", name, F.lower("c_mktsegment"), "c_nationkey").alias("value"))
    nations = read(spark, folder, "nation").select(F.format_string(':n%d skos:prefLabel "%s"@es ; skos:broader :r%d .', "n_nationkey", "n_name", "n_regionkey").alias("value"))
    regions = read(spark, folder, "region").select(F.format_string('<http://q/r%d> skos:prefLabel "%s" .', "r_regionkey", "r_name").alias("value"))
    head = spark.createDataFrame([("@prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n@prefix : <http://q/> .",)], "value string")
    path = new_path(spark, "turtle")
    head.unionByName(customers).unionByName(nations).unionByName(regions).write.text(path)
    return files.read_taxonomy(files.read_turtle(spark, path)).select("theme_id", "label", "parent_id", F.array_join("alternatives", "|").alias("others"))


@query(
    "graph_round_trip",
    """SELECT 'http://q/Order/' || o_orderkey AS subject, 'status' AS said, o_orderstatus AS value, NULL::VARCHAR AS type FROM orders
UNION ALL SELECT 'http://q/Order/' || o_orderkey, 'priority', o_orderpriority, NULL FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'http://q/Order/' || o_orderkey, 'day', strftime(o_orderdate, '%Y-%m-%d'), 'date' FROM orders
UNION ALL SELECT 'http://q/Order/' || o_orderkey, 'of', 'http://q/Customer/' || o_custkey, NULL FROM orders
UNION ALL SELECT 'http://q/Order/' || o_orderkey, 'type', 'http://q/Order', NULL FROM orders""",
)
def graph_round_trip(spark, folder):
    """Orders as a graph with links to their customers, written as triples and read again."""
    orders = read(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("of"))
    path = new_path(spark, "triples")
    files.triples(orders, "o_orderkey", "Order", "http://q/", links={"of": "Customer"}).write.text(path)
    rows = files.read_triples(spark, path)
    last = lambda c: F.regexp_extract(c, "[^/#]+$", 0)
    return rows.select("subject", last("predicate").alias("said"), F.coalesce("object", "literal", F.concat(F.lit("malformed "), "malformed")).alias("value"), last("type").alias("type"))


@query(
    "json_lines_round_trip",
    "SELECT doc_id, md5(text) AS digest, length(text) AS letters, concat_ws(' ', source, lang) AS tags FROM documents",
)
def json_lines_round_trip(spark, folder):
    """Whole documents with a list of tags, put in place as JSON lines and read again; a line that is no row would show as one without an id."""
    docs = read(spark, folder, "documents").select("doc_id", "text", F.array("source", "lang").alias("tags"))
    path = new_path(spark, "lines")
    files.write_json_lines(docs, path)
    rows = files.read_json_lines(spark, path, docs.schema)
    return rows.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("letters"), F.concat_ws(" ", "tags").alias("tags"))
