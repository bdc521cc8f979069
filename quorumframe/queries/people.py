"""Spellings that are one name, and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.functions.minutes import entity
from quorumframe.operators import similar
from quorumframe.registry import query, read

#: Names of twenty letters from numbers: each digit of a product is a letter, so most are far apart.
_LETTERS = "translate(lpad(CAST((%s * 48271 + 11) %% 2147483647 AS VARCHAR), 10, '0') || lpad(CAST((%s * 16807 + 7) %% 2147483647 AS VARCHAR), 10, '0'), '0123456789', 'aeioulnrst')"
_SPELLINGS = f"""WITH base AS (SELECT c_custkey AS id, {_LETTERS % ("c_custkey", "c_custkey")} AS name FROM customer UNION ALL SELECT s_suppkey + 1000000, {_LETTERS % ("(s_suppkey + 1000000)", "(s_suppkey + 1000000)")} FROM supplier),
spelling AS (
  SELECT id, name AS key, 5 AS n FROM base UNION ALL
  SELECT id, substr(name, 1, 7) || 'x' || substr(name, 9), 2 FROM base WHERE id % 3 = 0 UNION ALL
  SELECT id, substr(name, 1, 4) || substr(name, 6, 9) || substr(name, 16), 1 FROM base WHERE id % 4 = 0 UNION ALL
  SELECT id, substr(name, 1, 2) || 'zz' || substr(name, 5, 3) || 'x' || substr(name, 9), 1 FROM base WHERE id % 6 = 0)
"""


@query(
    "fused_names",
    "WITH RECURSIVE "
    + _SPELLINGS.removeprefix("WITH ")
    + """, one AS (SELECT key, sum(n) AS n FROM spelling GROUP BY 1),
pair AS (SELECT a.key AS a, b.key AS b FROM one AS a JOIN one AS b ON a.key <> b.key AND abs(length(a.key) - length(b.key)) <= 2 AND levenshtein(a.key, b.key) <= 2),
reach(a, b) AS (SELECT key, key FROM one UNION SELECT r.a, p.b FROM reach AS r JOIN pair AS p ON r.b = p.a)
SELECT a AS key, arg_max(b, (n, b)) AS person FROM reach JOIN one ON one.key = b GROUP BY a""",
)
def fused_names(spark, folder):
    """Customers and suppliers with planted misspellings, some of them only reached by way of others."""
    spelled = spark.createDataFrame([], "id long, key string, n int")
    for table, id_ in (("customer", F.col("c_custkey")), ("supplier", F.col("s_suppkey") + 1_000_000)):
        digits = lambda by, plus: F.lpad(((F.col("id") * by + plus) % 2147483647).cast("string"), 10, "0")
        base = read(spark, folder, table).select(id_.alias("id")).select("id", F.translate(F.concat(digits(48271, 11), digits(16807, 7)), "0123456789", "aeioulnrst").alias("name"))
        part = lambda start, size=None: F.substring("name", start, size or 100)
        forms = [
            (F.lit(True), F.col("name"), 5),
            (F.col("id") % 3 == 0, F.concat(part(1, 7), F.lit("x"), part(9)), 2),
            (F.col("id") % 4 == 0, F.concat(part(1, 4), part(6, 9), part(16)), 1),
            (F.col("id") % 6 == 0, F.concat(part(1, 2), F.lit("zz"), part(5, 3), F.lit("x"), part(9)), 1),
        ]
        for where, key, n in forms:
            spelled = spelled.unionByName(base.where(where).select("id", key.alias("key"), F.lit(n).alias("n")))
    return similar.fused(spelled)


@query(
    "entities_named",
    """WITH m AS (SELECT p_partkey % 6 AS m, p_name, p_size FROM part),
e AS (SELECT CASE m WHEN 0 THEN upper(p_name) || ' ' || p_size || ', S.A.' WHEN 2 THEN 'Dona  ' || p_name WHEN 3 THEN p_name || ', S. Coop., S.L.' ELSE p_name END AS said,
  CASE m WHEN 0 THEN 'organizacion' WHEN 2 THEN 'persona' WHEN 3 THEN 'organizacion' ELSE 'entidad' END AS kind,
  CASE m WHEN 0 THEN replace(p_name, ' ', '_') || '_' || p_size WHEN 2 THEN 'dona_' || replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '_') END AS key FROM m WHERE m IN (0, 2, 3, 4))
SELECT key, kind, replace(min(said), '  ', ' ') AS label, count(*) AS n FROM e GROUP BY 1, 2""",
)
def entities_named(spark, folder):
    """Part names as companies, people, institutions, plans and junk: one row for each that is an entity, whatever its legal form or accents."""
    name, turn = F.col("p_name"), F.col("p_partkey") % 6
    forms = [
        (F.concat(F.upper(name), F.lit(" "), F.col("p_size"), F.lit(", S.A.")), "Empresa"),
        (F.concat(F.lit("El Sr. "), F.substring_index(name, " ", 1)), "Concejal"),  # a speaker
        (F.concat(F.lit("Doña  "), name), " Persona "),
        (F.concat(name, F.lit(", S. Coop., S.L.")), "institución"),
        (name, None),
        (F.lit("el Grupo"), "organización"),
    ]
    said, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (form, called) in enumerate(forms):
        said, kind = F.when(turn == k, form).otherwise(said), F.when(turn == k, F.lit(called)).otherwise(kind)
    found = read(spark, folder, "part").select(said.alias("said"), kind.alias("called")).select(entity("said", "called").alias("e")).where("e is not null").select("e.*")
    return found.groupBy("key", "kind").agg(F.min("label").alias("label"), F.count("*").alias("n"))
