"""Tokens, rarity, literal hits, ids, JSON, chunks and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumframe.functions import text as T
from quorumframe.functions.chunks import chunks
from quorumframe.functions.links import page_links
from quorumframe.operators.matching import sharing_words
from quorumframe.operators.postings import PostingsIndex
from quorumframe.operators.windows import newest, rarest
from quorumframe.registry import query, read
from quorumframe.storage import new_path, spread


def _words(column: str = "text") -> str:
    return f"regexp_extract_all(lower(translate({column}, 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY')), '[a-z]+')"


def texts(spark, folder):
    return spread(read(spark, folder, "documents"))


#: The index of each session and folder; what is in it already is not read again.
_INDEXES: dict[tuple[str, str], PostingsIndex] = {}


def document_index(spark, folder) -> PostingsIndex:
    """The index of the documents of a folder, with those added that it lacks."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEXES:
        _INDEXES[key] = PostingsIndex(spark, new_path(spark, "document-index"))
    index = _INDEXES[key]
    if not read(spark, folder, "documents").select(F.col("doc_id").alias("doc")).join(index.docs.select("doc"), "doc", "left_anti").isEmpty():  # numbers only
        index.append(texts(spark, folder), "doc_id", "text")
    return index


_TOKENS = f"tokens AS (SELECT DISTINCT doc_id, unnest({_words()}) AS w FROM documents), items AS (SELECT DISTINCT item_id, unnest({_words()}) AS w FROM benchmark)"


@query(
    "df_rarest_terms",
    f"""WITH {_TOKENS}, t AS (SELECT * FROM tokens WHERE length(w) >= 5), df AS (SELECT w, count(*) AS df FROM t GROUP BY 1)
SELECT doc_id, w, df FROM t JOIN df USING (w) WHERE df <= 0.02 * (SELECT count(DISTINCT doc_id) FROM t)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, length(w) DESC, w) <= 20""",
)
def df_rarest_terms(spark, folder):
    held = texts(spark, folder).select("doc_id", F.array_distinct(T.words("text", 5)).alias("ws"))
    return rarest(held, "ws", "doc_id", most_share=0.02, per_owner=20).select("doc_id", F.col("item").alias("w"), "df")


def _worded(spark, folder, name: str, key: str, least: int = 1):
    rows = read(spark, folder, name)
    return (spread(rows) if name == "documents" else rows).select(key, F.array_distinct(T.words("text", least)).alias("words"))


@query(
    "jaccard_topk",
    f"""WITH {_TOKENS}, nd AS (SELECT doc_id, count(*) AS a FROM tokens GROUP BY 1), ni AS (SELECT item_id, count(*) AS b FROM items GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS k FROM tokens JOIN items USING (w) GROUP BY 1, 2)
SELECT doc_id, item_id, round(k / (a + b - k), 6) AS score FROM c JOIN nd USING (doc_id) JOIN ni USING (item_id)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(k / (a + b - k), 6) DESC, item_id) <= 3""",
)
def jaccard_topk(spark, folder):
    met = sharing_words(_worded(spark, folder, "documents", "doc_id"), "doc_id", _worded(spark, folder, "benchmark", "item_id"), "item_id", k=3)
    return met.select("doc_id", F.col("bank_id").alias("item_id"), F.round(F.col("common") / (F.col("of_own") + F.col("of_bank") - F.col("common")), 6).alias("score"))


@query(
    "token_overlap_match",
    f"WITH {_TOKENS} SELECT doc_id, item_id, count(*) AS common FROM tokens JOIN items USING (w) WHERE length(w) >= 4 GROUP BY 1, 2 HAVING count(*) >= 4",
)
def token_overlap_match(spark, folder):
    met = sharing_words(_worded(spark, folder, "documents", "doc_id", 4), "doc_id", _worded(spark, folder, "benchmark", "item_id", 4), "item_id", least=4)
    return met.select("doc_id", F.col("bank_id").alias("item_id"), "common")


@query(
    "keyword_rarity",
    f"""WITH {_TOKENS}, h AS (SELECT item_id, w, count(doc_id) AS hits FROM items JOIN tokens USING (w) WHERE length(w) >= 6 GROUP BY 1, 2)
SELECT item_id, w, least(hits, 3000) AS hits FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY least(hits, 3000), length(w) DESC, w) <= 3""",
)
def keyword_rarity(spark, folder):
    asked = read(spark, folder, "benchmark").select("item_id", F.explode(F.array_distinct(T.words("text", 6))).alias("w"))
    docs = texts(spark, folder).select(F.explode(F.array_distinct(T.words("text", 6))).alias("w"))
    hits = docs.join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.least(F.count("*"), F.lit(3000)).alias("hits"))
    return newest(asked.join(hits, "w").select("item_id", "w", "hits"), ["item_id"], ["hits", F.desc(F.length("w")), "w"], 3)


_PHRASES = ("licensed under", "versión", "público", "año")


@query(
    "literal_hits",
    r"""WITH d AS (SELECT lang, translate(lower(text), 'áàâäãåçéèêëíìîïóòôöõúùûüýÿ', 'aaaaaaceeeeiiiiooooouuuuyy') AS t FROM documents)
SELECT lang, count(CASE WHEN regexp_matches(t, '(^|[^\pL\pN_])licensed\s+under(s|es)?($|[^\pL\pN_])') THEN 1 END) AS hits_0,
       count(CASE WHEN regexp_matches(t, '(^|[^\pL\pN_])version(s|es)?($|[^\pL\pN_])') THEN 1 END) AS hits_1,
       count(CASE WHEN regexp_matches(t, '(^|[^\pL\pN_])publico(s|es)?($|[^\pL\pN_])') THEN 1 END) AS hits_2,
       count(CASE WHEN regexp_matches(t, '(^|[^\pL\pN_])a(n|ñ)o(s|es)?($|[^\pL\pN_])') THEN 1 END) AS hits_3 FROM d GROUP BY 1""",
)
def literal_hits(spark, folder):
    """From the index: documents are met by number and language, not by text."""
    hits = document_index(spark, folder).phrases(_PHRASES).groupBy("doc").agg(F.collect_set("phrase").alias("held"))
    docs = read(spark, folder, "documents").select("doc_id", "lang").join(hits, F.col("doc_id") == F.col("doc"), "left")
    return docs.groupBy("lang").agg(*(F.count_if(F.array_contains("held", k)).alias(f"hits_{k}") for k in range(len(_PHRASES))))


@query(
    "literal_hits_by_scan",
    r"""WITH d AS (SELECT doc_id, translate(lower(text), 'áàâäãåçéèêëíìîïóòôöõúùûüýÿ', 'aaaaaaceeeeiiiiooooouuuuyy') AS t FROM documents)
SELECT doc_id, regexp_matches(t, '(^|[^\pL\pN_])public\s+license(s|es)?($|[^\pL\pN_])') AS license, regexp_matches(t, '(^|[^\pL\pN_])a(n|ñ)o(s|es)?($|[^\pL\pN_])') AS ano FROM d""",
)
def literal_hits_by_scan(spark, folder):
    """The same patterns over texts that no index has."""
    said = T.searchable("text")
    return texts(spark, folder).select("doc_id", said.rlike(T.literal_pattern("public license")).alias("license"), said.rlike(T.literal_pattern("año")).alias("ano"))


@query(
    "opening_phrases",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(lower(text), 'áàâäãåçéèêëíìîïóòôöõúùûüýÿ', 'aaaaaaceeeeiiiiooooouuuuyy'), '[\pL\pN_]+|[^\pL\pN_\s]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(lower(text), 'áàâäãåçéèêëíìîïóòôöõúùûüýÿ', 'aaaaaaceeeeiiiiooooouuuuyy'), '[\pL\pN_]+') AS w FROM benchmark),
p AS (SELECT item_id, array_to_string(w[1:3], ' ') AS phrase FROM i WHERE len(w) >= 3),
t AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d)
SELECT item_id, count(doc_id) AS n FROM p LEFT JOIN t ON regexp_matches(t, ' ' || CASE
    WHEN length(regexp_extract(phrase, '\S+$')) > 5 AND phrase LIKE '%es' THEN replace(left(phrase, length(phrase) - 2), 'ñ', '(n|ñ)') || '(e|es)?'
    WHEN length(regexp_extract(phrase, '\S+$')) > 4 AND phrase LIKE '%s' THEN replace(left(phrase, length(phrase) - 1), 'ñ', '(n|ñ)') || 's?'
    ELSE replace(phrase, 'ñ', '(n|ñ)') || '(s|es)?' END || ' ') GROUP BY item_id""",
)
def opening_phrases(spark, folder):
    """In how many documents the first three words of each benchmark item stand side by side."""
    words = F.regexp_extract_all(T.searchable("text"), F.lit(r"[\pL\pN_]+"), F.lit(0))
    items = read(spark, folder, "benchmark").select("item_id", words.alias("w")).where("size(w) >= 3").select("item_id", F.array_join(F.slice("w", 1, 3), " ").alias("p")).collect()  # the stated phrases
    index = document_index(spark, folder)
    hits = index.phrases([r["p"] for r in items]).groupBy("phrase").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([(r["item_id"], k) for k, r in enumerate(items)], "item_id long, phrase int")
    return asked.join(hits, "phrase", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("point_id_md5", "SELECT doc_id, left(md5(source || '||' || left(text, 80)), 16) AS point_id, left(sha1(doc_id || '|' || lang), 16) AS speech_id FROM documents")
def point_id_md5(spark, folder):
    docs = texts(spark, folder)
    return docs.select("doc_id", T.short_id("source", F.substring("text", 1, 80)).alias("point_id"), T.short_id("doc_id", "lang", method="sha1").alias("speech_id"))


@query("json_props", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS n FROM events GROUP BY 1")
def json_props(spark, folder):
    events = read(spark, folder, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return events.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count_distinct("p.k").alias("n"))


@query(
    "slugs",
    f"""WITH s AS (SELECT p_partkey, left(trim(regexp_replace(lower(translate(p_name, 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY')), '[^a-z0-9]+', '_', 'g'), '_'), 60) AS slug FROM part)
SELECT p_partkey, CASE WHEN slug = '' THEN 'x' ELSE slug END AS slug FROM s""",
)
def slugs(spark, folder):
    return read(spark, folder, "part").select("p_partkey", T.slug("p_name").alias("slug"))


@query("stems", f"SELECT DISTINCT w, CASE WHEN length(w) > 5 THEN regexp_replace(w, '(es|as|os|s|a|o|e)$', '') ELSE w END AS stem FROM (SELECT unnest({_words()}) AS w FROM documents)")
def stems(spark, folder):
    words = texts(spark, folder).select(F.explode(T.words("text")).alias("w")).distinct()
    return words.select("w", T.stem("w").alias("stem"))


_ES, _EU = ("de", "la", "que", "el", "en", "y", "los", "las"), ("eta", "da", "ez", "du", "hau", "dela")


@query(
    "lang_filter",
    f"""WITH c AS (SELECT doc_id, len(list_filter({_words()}, lambda w: w IN {_ES})) AS es, len(list_filter({_words()}, lambda w: w IN {_EU})) AS eu FROM documents)
SELECT doc_id, es, eu FROM c WHERE eu = 0 OR es > 2 * eu""",
)
def lang_filter(spark, folder):
    docs = texts(spark, folder).select("doc_id", T.words("text").alias("ws"))
    counts = docs.select("doc_id", T.count_of("ws", _ES).alias("es"), T.count_of("ws", _EU).alias("eu"))
    return counts.where("eu = 0 or es > 2 * eu")


def _end(start: str) -> str:
    """Where a chunk from start ends, in SQL: after the last of the first separator that its second half holds."""
    window = f"substr(text, {start} + 601, 600)"
    last = "".join(f" WHEN contains({window}, {sep}) THEN {start} + 1201 - instr(reverse({window}), reverse({sep}))" for sep in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"))
    return f"CASE WHEN {start} + 1200 >= length(text) THEN length(text){last} ELSE {start} + 1200 END"


@query(
    "chunk_overlap",
    f"""WITH RECURSIVE c AS (
  SELECT doc_id, text, 0 AS k, 0::BIGINT AS s, {_end("0")} AS e FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, text, k + 1, e - 200, {_end("(e - 200)")} FROM c WHERE e < length(text))
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, s AS start, substr(text, s + 1, e - s) AS chunk FROM c""",
)
def chunk_overlap(spark, folder):
    return chunks(texts(spark, folder), "doc_id", "text", size=1200, overlap=200)


_LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*>(.*?)</a>"""


@query(
    "html_links",
    rf"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS href, regexp_extract_all(html, '{_LINK}', 2) AS label FROM pages)
SELECT page_id, CAST(k - 1 AS INTEGER) AS place, href[k] AS href, trim(regexp_replace(label[k], '<[^>]*>|\s+', ' ', 'g')) AS label FROM l, unnest(range(1, len(href) + 1)) AS u(k)""",
)
def html_links(spark, folder):
    return page_links(spread(read(spark, folder, "pages")))
