"""Vector search, reranking, prototypes, fusion and contexts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quorumframe.operators import vectors
from quorumframe.plans import retrieval
from quorumframe.queries.texts import document_index
from quorumframe.registry import query, read
from quorumframe.storage import materialise, spread

_PAIRS = """WITH p AS (
  SELECT q.vec_id AS query_id, v.vec_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS distance
  FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 100 = 0)
"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)"


def _queries(spark, folder):
    every = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return every, every.where("vec_id % 100 = 0")


@query("knn_topk", _PAIRS + f"SELECT query_id, vec_id, round(distance, 6) + 0.0 AS distance, {_RANK} AS rank FROM p QUALIFY {_RANK} <= 10")
def knn_topk(spark, folder):
    return vectors.nearest(*_queries(spark, folder), k=10).withColumn("distance", F.round("distance", 6) + 0.0)


@query("knn_threshold", _PAIRS + f"SELECT query_id, vec_id, {_RANK} AS rank FROM p WHERE distance < 0.7 QUALIFY {_RANK} <= 50")
def knn_threshold(spark, folder):
    return vectors.nearest(*_queries(spark, folder), k=50, at_most=0.7).drop("distance")


@query(
    "rerank_cosine",
    """WITH c AS (SELECT vec_id, embedding FROM embeddings WHERE label = 3), q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM c, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 20""",
)
def rerank_cosine(spark, folder):
    every = read(spark, folder, "embeddings")
    question = [float(x) for x in every.where("vec_id = 0").first()["embedding"]]
    candidates = every.where("label = 3").select("vec_id", "embedding")
    scored = candidates.select("vec_id", vectors.cosine("embedding", F.array(*map(F.lit, question))).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20).withColumn("score", F.round("score", 6))


@query(
    "prototype_match",
    """WITH proto AS (SELECT label, min_by(embedding, vec_id) AS e FROM embeddings GROUP BY 1),
s AS (SELECT vec_id, proto.label AS name, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS score FROM embeddings, proto),
b AS (SELECT vec_id, name, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, CAST(name AS VARCHAR)) = 1)
SELECT vec_id, CASE WHEN score >= 0.55 THEN CAST(name AS VARCHAR) END AS prototype, CASE WHEN score >= 0.55 THEN round(score, 6) END AS score FROM b""",
)
def prototype_match(spark, folder):
    every = read(spark, folder, "embeddings")
    prototypes = every.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.col("label").cast("string").alias("name"), "embedding")
    return vectors.assign_prototypes(every, prototypes).withColumn("score", F.round("score", 6))


@query(
    "channel_fusion",
    """WITH ch AS (
  SELECT 0 AS o, 'semantic' AS channel, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents UNION ALL
  SELECT 1, 'thematic', doc_id, row_number() OVER (ORDER BY doc_id) FROM documents WHERE lang = 'es' UNION ALL
  SELECT 2, 'keyword', doc_id, row_number() OVER (ORDER BY doc_id DESC) FROM documents WHERE source = 'src1'),
c AS (SELECT * FROM ch WHERE rank <= CASE channel WHEN 'semantic' THEN 22 WHEN 'thematic' THEN 22 ELSE 24 END)
SELECT doc_id AS frag_id, channel, rank, o * 1000000000 + rank AS place FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o, rank) = 1""",
)
def channel_fusion(spark, folder):
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("frag_id"), "lang", "source", "n_chars")

    def channel(rows, cap, *order):
        top = rows.orderBy(*order).limit(cap)
        return top.select("frag_id", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # cap rows

    return retrieval.fuse(
        {
            "semantic": channel(docs, 22, F.desc("n_chars"), "frag_id"),
            "thematic": channel(docs.where("lang = 'es'"), 22, "frag_id"),
            "keyword": channel(docs.where("source = 'src1'"), 24, F.desc("frag_id")),
        }
    )


@query(
    "retrieve_context",
    r"""WITH fragment AS (SELECT doc_id AS frag_id, DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) AS date, source, lang AS topic, text,
  translate(lower(text), 'áàâäãåçéèêëíìîïóòôöõúùûüýÿ', 'aaaaaaceeeeiiiiooooouuuuyy') AS said FROM documents),
near AS (SELECT v.vec_id AS frag_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings AS v, embeddings AS q WHERE q.vec_id = 0),
semantic AS (SELECT frag_id, score, row_number() OVER (ORDER BY 1 - score, frag_id) AS rank FROM near QUALIFY rank <= 80),
spread AS (SELECT frag_id, date, row_number() OVER (ORDER BY date, frag_id) - 1 AS k, count(*) OVER () AS n FROM fragment WHERE topic = 'es'),
thematic AS (SELECT frag_id, row_number() OVER (ORDER BY date, frag_id) AS rank FROM spread WHERE n <= 40 OR k IN (SELECT round_even(i * (n - 1) / 39.0, 0) FROM range(40) AS t(i))),
hit AS (
  SELECT frag_id, date, 'licensed under' AS phrase FROM fragment WHERE regexp_matches(said, '(^|[^\pL\pN_])licensed\s+under(s|es)?($|[^\pL\pN_])') UNION ALL
  SELECT frag_id, date, 'version' FROM fragment WHERE regexp_matches(said, '(^|[^\pL\pN_])version(s|es)?($|[^\pL\pN_])') UNION ALL
  SELECT frag_id, date, 'public license' FROM fragment WHERE regexp_matches(said, '(^|[^\pL\pN_])public\s+license(s|es)?($|[^\pL\pN_])')),
list AS (SELECT phrase, row_number() OVER (ORDER BY least(count(*), 3000), -length(phrase), phrase) AS list FROM hit GROUP BY 1),
turn AS (SELECT frag_id, list, row_number() OVER (PARTITION BY list ORDER BY date DESC, frag_id) AS turn FROM hit JOIN list USING (phrase) QUALIFY turn <= 40),
once AS (SELECT * FROM turn QUALIFY row_number() OVER (PARTITION BY frag_id ORDER BY turn, list) = 1),
keyword AS (SELECT frag_id, row_number() OVER (ORDER BY turn, list) AS rank FROM once),
channel AS (SELECT 0 AS o, 'semantic' AS channel, frag_id, rank FROM semantic WHERE rank <= 22 UNION ALL SELECT 1, 'thematic', frag_id, rank FROM thematic WHERE rank <= 22 UNION ALL SELECT 2, 'keyword', frag_id, rank FROM keyword WHERE rank <= 24),
candidate AS (SELECT frag_id, channel, o * 1000000000 + rank AS place FROM channel QUALIFY row_number() OVER (PARTITION BY frag_id ORDER BY o, rank) = 1),
scored AS (SELECT c.*, s.score IS NULL AND channel = 'keyword' AS filler, coalesce(s.score, CASE WHEN channel = 'keyword' THEN 0.02 END) AS score FROM candidate AS c LEFT JOIN semantic AS s USING (frag_id)),
ranked AS (SELECT * FROM scored WHERE score IS NOT NULL AND (SELECT max(score) FROM scored WHERE NOT filler) >= 0.01),
chosen AS (
  (SELECT frag_id FROM ranked ORDER BY score DESC, place LIMIT 15) UNION
  (SELECT frag_id FROM ranked WHERE channel <> 'keyword' OR NOT filler ORDER BY score DESC, place LIMIT 8) UNION
  (SELECT frag_id FROM ranked WHERE channel = 'keyword' ORDER BY score DESC, place LIMIT 10)),
block AS (SELECT date, topic, source, left(string_agg(text, chr(10) ORDER BY text), 3800) AS text FROM fragment WHERE frag_id IN (SELECT frag_id FROM chosen) GROUP BY 1, 2, 3),
total AS (SELECT *, sum(length(text)) OVER (ORDER BY date, topic, source ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY date, topic, source) AS k FROM block)
SELECT date, topic, source, NULL::VARCHAR AS vote_result, text FROM total WHERE upto <= 20000 OR k = 1""".replace("\\\\", "\\"),
)
def retrieve_context(spark, folder):
    """A whole retrieval: three channels, fusion, scores, relevance, diversity over sources, and a context of blocks."""
    docs = spread(read(spark, folder, "documents"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int"))
    fragments = docs.select(F.col("doc_id").alias("frag_id"), day.alias("date"), F.year(day).alias("year"), "source", F.col("lang").alias("topic"), F.lit(0).alias("chunk_index"), "text", F.lit(None).cast("string").alias("vote_result"))
    every, asked = _queries(spark, folder)
    near = materialise(vectors.nearest(every, asked.where("vec_id = 0"), k=80), "near")
    channels = {
        "semantic": near.select(F.col("vec_id").alias("frag_id"), "rank"),
        "thematic": retrieval.thematic_channel(fragments, F.col("topic") == "es"),
        "keyword": retrieval.keyword_channel(fragments, ["licensed under", "version", "public license"], index=document_index(spark, folder)),
    }
    scored = near.select(F.col("vec_id").alias("frag_id"), (1 - F.col("distance")).alias("score"))
    # a few tens of candidates, which all that follows reads several times
    ranked = materialise(retrieval.relevant(retrieval.with_fillers(scored, retrieval.fuse(channels))), "ranked")
    chosen = retrieval.with_rescued(ranked.orderBy(F.desc("score"), "place").limit(15), ranked)
    return retrieval.context(fragments, chosen)
