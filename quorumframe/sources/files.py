"""Sources and sinks: texts, binaries, JSON lines, tables by year, triples."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from quorumframe.operators.joins import resume
from quorumframe.storage import materialise


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """path, file, text of whole files under a folder, whatever their depth."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, file, bytes and changed of the files under a folder, without reading them; folders without any give no rows."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def pages_of(texts: DataFrame, text: str = "text", mark: str = "\f") -> DataFrame:
    """file, page (from 1) and text of each page; pages end at a form feed."""
    return texts.select("file", F.posexplode(F.split(text, mark, -1)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def without_text(pages: DataFrame) -> DataFrame:
    """Files none of whose pages has text: those that have to be recognised."""
    return pages.groupBy("file").agg(F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))).alias("letters")).where("letters = 0").select("file")


def with_recognised(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """pages, with the recognised text where there is one."""
    better = recognised.select("file", "page", F.col("text").alias("_better"))
    return pages.join(better, ["file", "page"], "left").withColumn("text", F.coalesce("_better", "text")).drop("_better")


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a fixed schema; lines that are no JSON of it are kept whole in _corrupt_record."""
    kept = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(kept).option("mode", "PERMISSIVE").json(path)


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and what makes a path of its own type."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _exists(spark: SparkSession, path: str) -> bool:
    system, make = _file_system(spark, path)
    return system.exists(make(path))


def replace_with(spark: SparkSession, path: str, write) -> None:
    """What stands at path is replaced once write(new path) has written all; until then it stays whole.

    The new folder is written beside the old one and both are renamed, so a write that
    breaks off leaves the old one, and at any time one of the two is there in full.
    """
    system, make = _file_system(spark, path)
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    write(new)
    had = system.exists(make(path))
    if had and not system.rename(make(path), make(old)) or not system.rename(make(new), make(path)):
        raise OSError(f"could not put {new} in the place of {path}")
    if had:
        system.delete(make(old), True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Replaces what is there once all is written; see replace_with."""
    replace_with(df.sparkSession, path, lambda new: df.write.json(new))


def write_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """A table of results as CSV with a header, or as JSON lines, replaced once all is written."""
    replace_with(df.sparkSession, path, lambda new: df.write.format(form).option("header", "true").save(new))


def append_new(source: DataFrame, path: str, key: str, enrich=lambda df: df, form: str = "parquet") -> int:
    """Rows of source whose key is not in the table at path yet, enriched and appended; how many.

    Work that was broken off goes on where it stopped: only committed rows count. What
    cannot be read at path is an error, not an empty table.
    """
    spark = source.sparkSession
    before = 0
    if _exists(spark, path):
        done = spark.read.format(form).option("header", "true").load(path)
        before, source = done.count(), resume(source, done, key)
    enrich(source).write.format(form).option("header", "true").mode("append").save(path)
    return spark.read.format(form).option("header", "true").load(path).count() - before


def missing_files(wanted: DataFrame, folder: str, name: str = "file") -> DataFrame:
    """Rows of wanted whose file, by its safe name, is not under the folder yet."""
    spark = wanted.sparkSession
    if not _exists(spark, folder):
        return wanted
    held = list_files(spark, folder, "*").select(F.col("file").alias("_held")).distinct()
    return wanted.join(held, safe_name(name) == F.col("_held"), "left_anti")


def replace_years(df: DataFrame, path: str, year: Column) -> None:
    """Writes a table in folders by year; years that df has are replaced, others stay."""
    df.withColumn("year", year).write.mode("overwrite").partitionBy("year").option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_dates(df: DataFrame, path: str, date: str) -> None:
    """Replaces the rows of the dates that df has in a table in folders by year; other dates stay.

    Only the years of these dates are read and written again, and only after all their
    rows, old and new, stand in the shared folder.
    """
    spark = df.sparkSession
    rows = df.withColumn("year", F.year(date))
    if _exists(spark, path):
        years, dates = rows.select("year").distinct(), rows.select(date).distinct()
        kept = spark.read.parquet(path).join(years, "year", "left_semi").join(dates, date, "left_anti")
        rows = materialise(rows.unionByName(kept, allowMissingColumns=True), "rebuilt")
    replace_years(rows.drop("year"), path, F.year(date))


def safe_name(c: Column | str) -> Column:
    """A file name without the characters that file systems refuse."""
    return F.btrim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r'[\\/*?:"<>|]+', ""))


def triples(table: DataFrame, subject: str, kind: str, base: str, links: Mapping[str, str] | None = None) -> DataFrame:
    """One N-Triples line, which is Turtle too, for the class of each row and for each of its values that is not null.

    links names the columns that hold keys of other rows, with the kind of those rows:
    such a value is written as what it leads to, an array of keys as one line for each.
    """
    links = dict(links or {})
    uri = lambda c: F.concat(F.lit(f"<{base}{kind}/"), F.col(c).cast("string"), F.lit(">"))

    def literal(field: StructField) -> Column:
        raw = F.col(field.name).cast("string")
        escaped = F.replace(F.replace(F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        # Names of types of XML Schema.
        name = {"integer": "integer", "bigint": "integer", "double": "double", "date": "date", "boolean": "boolean"}.get(field.dataType.simpleString(), "decimal" if field.dataType.simpleString().startswith("decimal") else None)
        return F.concat(F.lit('"'), escaped, F.lit('"' if name is None else f'"^^<http://www.w3.org/2001/XMLSchema#{name}>'))

    lines = [F.concat(uri(subject), F.lit(f" <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{base}{kind}> ."))]
    said = lambda c, value: F.concat(uri(subject), F.lit(f" <{base}{c}> "), value, F.lit(" ."))
    lines += [F.when(F.col(f.name).isNotNull(), said(f.name, literal(f))) for f in table.schema if f.name != subject and f.name not in links]
    arrays = [F.array(*lines)]
    for c, other in links.items():
        keys = F.col(c) if table.schema[c].dataType.typeName() == "array" else F.array(c)
        led = F.transform(keys, lambda k: said(c, F.concat(F.lit(f"<{base}{other}/"), k.cast("string"), F.lit(">"))))  # noqa: B023
        arrays.append(F.coalesce(led, F.array().cast("array<string>")))
    return table.select(F.explode(F.array_compact(F.concat(*arrays))).alias("value"))


_TRIPLE = r"""^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?)\s*\.\s*$"""


def _unescaped(c: Column) -> Column:
    for written, meant in (("\\\\", "\0"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\0", "\\")):
        c = F.replace(c, F.lit(written), F.lit(meant))
    return c


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate, object (a URI) or literal with lang and type, one row per line of N-Triples; comments and blank lines go.

    A line that is no triple is kept whole in malformed.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    part = lambda k: F.regexp_extract("value", _TRIPLE, k)
    given = lambda k: F.when(part(k) != "", part(k))
    raw = _unescaped(part(4))
    fits = F.col("value").rlike(_TRIPLE)
    return lines.select(given(1).alias("subject"), given(2).alias("predicate"), given(3).alias("object"), F.when(fits & (part(3) == ""), raw).alias("literal"), given(5).alias("lang"), given(6).alias("type"), F.when(~fits, F.col("value")).alias("malformed"))


# What a Turtle statement is made of: URIs, literals with a language or type, numbers and truth values, short names, "a", and signs, comments.
_URI, _SHORT = r"<[^<>\s]*>", r"(?:[\pL\pN_-][\pL\pN_.-]*)?:(?:[\pL\pN_:%-](?:[\pL\pN_:%.-]*[\pL\pN_:%-])?)?"
_QUOTED = rf"""(?:\"\"\"(?s:.*?)(?<!\\)\"\"\"|"(?:[^"\\\n]|\\.)*")(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^(?:{_URI}|{_SHORT}))?"""
_TOKEN = rf"""{_QUOTED}|{_URI}|@?(?i:prefix|base)(?=\s)|{_SHORT}|[+-]?[0-9]+(?:\.[0-9]+)?(?![\pL\pN])|\b(?:a|true|false)(?![\pL\pN:_-])|[;,.]|#[^\n]*"""


def read_turtle(spark: SparkSession, path: str, *, line_end: str = "\n") -> DataFrame:
    """subject, predicate, object (a URI) or literal with lang and type, as read_triples gives them, from Turtle.

    Statements, not lines, are the records, so a large file is read in parts: it is cut
    where a dot ends a line. A literal that goes on over such an end, blank nodes, lists and
    a base are not read; what holds them is kept whole in malformed. Short names take the
    prefixes of all files of the path (some rows, brought to the driver), which must agree;
    one without a prefix that is declared is malformed too.
    """
    cut = spark.read.option("lineSep", "." + line_end).text(path)
    tokens = F.filter(F.regexp_extract_all("value", F.lit(_TOKEN), 0), lambda t: ~t.startswith("#"))
    whole = F.regexp_replace(F.regexp_replace("value", _TOKEN, ""), r"\s+", "") == ""
    records = cut.select("value", tokens.alias("t"), whole.alias("whole")).where((F.size("t") > 0) | ~F.col("whole"))
    # a declaration of its own: its word, a prefix, a URI, and the dot if it was not cut off
    declares = F.lower(F.try_element_at("t", F.lit(1))).isin("@prefix", "prefix") & F.col("whole") & F.col("t")[2].startswith("<") & ((F.size("t") == 3) | ((F.size("t") == 4) & (F.element_at("t", -1) == ".")))
    declares = F.coalesce(declares, F.lit(False))
    found = records.where(declares).select(F.col("t")[1].alias("prefix"), F.regexp_extract(F.col("t")[2], "^<(.*)>$", 1).alias("uri")).distinct().collect()
    known = dict(sorted(map(tuple, found)))
    if len(known) < len(found):
        raise ValueError("a prefix has several meanings in these files: read them one by one")
    prefixes = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else F.create_map().cast("map<string,string>")

    def long(token: Column) -> Column:
        """The URI of a token; null if it is none, or a short name without a known prefix."""
        head = F.concat(F.substring_index(token, ":", 1), F.lit(":"))
        rest = F.substring(token, F.length(head) + 1, F.length(token))
        named = F.concat(F.try_element_at(prefixes, head), rest)
        return F.when(token == "a", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type")).when(token.startswith("<"), F.regexp_extract(token, "^<(.*)>$", 1)).when(token.rlike(f"^{_SHORT}$"), named)

    # one pass over the tokens of a statement: s and p are what is being said of what, out what has been said
    empty = F.lit(None).cast("string")
    start = F.struct(empty.alias("s"), empty.alias("p"), F.array().cast("array<struct<s:string,p:string,o:string>>").alias("out"))

    def step(state: Column, token: Column) -> Column:
        more = F.concat(state["out"], F.array(F.struct(state["s"].alias("s"), state["p"].alias("p"), token.alias("o"))))
        of = lambda s, p, out: F.struct(s.alias("s"), p.alias("p"), out.alias("out"))
        return (
            F.when(token == ".", of(empty, empty, state["out"]))
            .when(token == ";", of(state["s"], empty, state["out"]))
            .when(token == ",", state)
            .when(state["s"].isNull(), of(token, empty, state["out"]))
            .when(state["p"].isNull(), of(state["s"], token, state["out"]))
            .otherwise(of(state["s"], state["p"], more))
        )

    directive = F.col("t")[0].rlike("^@|^(?i:prefix|base)$")  # left over: one that is not read
    said = F.aggregate(F.when(F.col("whole") & ~directive, F.col("t")).otherwise(F.array().cast("array<string>")), start, step)["out"]
    rows = records.where(~declares).select("value", said.alias("out"))
    each = rows.select("value", F.explode_outer("out").alias("e")).select("value", long(F.col("e.s")).alias("subject"), long(F.col("e.p")).alias("predicate"), F.col("e.o").alias("o"))
    quoted = F.col("o").startswith('"')
    body = F.when(F.col("o").startswith('"""'), F.regexp_extract("o", r'^"""((?s:.*?))(?<!\\)"""', 1)).otherwise(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1))
    kind = F.regexp_extract("o", r'"\^\^([^"]+)$', 1)
    plain = F.col("o").rlike(r"^(?:[+-]?[0-9][0-9.]*|true|false)$")
    # Names of types of XML Schema.
    own = F.concat(F.lit("http://www.w3.org/2001/XMLSchema#"), F.when(F.col("o").isin("true", "false"), "boolean").when(F.col("o").contains("."), "decimal").otherwise("integer"))
    lang = F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1)
    made = each.select(
        "value", "subject", "predicate",
        F.when(~quoted & ~plain, long(F.col("o"))).alias("object"),
        F.when(quoted, _unescaped(body)).when(plain, F.col("o")).alias("literal"),
        F.when(quoted & (lang != ""), lang).alias("lang"),
        F.when(plain, own).when(quoted & (kind != ""), long(kind)).alias("type"),
    )
    fits = F.col("subject").isNotNull() & F.col("predicate").isNotNull() & (F.col("object").isNotNull() | F.col("literal").isNotNull())
    given = [F.when(fits, F.col(c)).alias(c) for c in ("subject", "predicate", "object", "literal", "lang", "type")]
    return made.select(*given, F.when(~fits, F.col("value")).alias("malformed"))


def read_taxonomy(triples_: DataFrame) -> DataFrame:
    """theme_id, label, parent_id and alternatives of the concepts of a SKOS vocabulary; a concept with several broader ones has a row for each.

    The preferred label is the one in Spanish, else the smallest; all others, with the
    alternative ones, are alternatives.
    """
    # Names of SKOS.
    skos = "http://www.w3.org/2004/02/skos/core#"
    concept = F.col("subject").alias("theme_id")
    preferred = F.struct(F.coalesce(F.col("lang") == "es", F.lit(False)).cast("int").alias("es"), F.col("literal").alias("label"))
    named = triples_.where(F.col("predicate").isin(skos + "prefLabel", skos + "altLabel")).groupBy(concept).agg(
        F.min_by("literal", F.struct(-preferred["es"], preferred["label"])).alias("_any"),
        F.min_by(F.when(F.col("predicate") == skos + "prefLabel", F.col("literal")), F.when(F.col("predicate") == skos + "prefLabel", F.struct(-preferred["es"], preferred["label"]))).alias("label"),
        F.array_sort(F.collect_set("literal")).alias("_all"),
    )
    above = triples_.where(F.col("predicate") == skos + "broader").select(concept, F.col("object").alias("parent_id")).distinct()
    label = F.coalesce("label", "_any")
    return named.join(above, "theme_id", "left").select("theme_id", label.alias("label"), "parent_id", F.filter("_all", lambda x: x != label).alias("alternatives"))
