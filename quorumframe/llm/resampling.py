"""Importance resampling towards a target distribution, over hashed n-grams.

A position table has one row for each word of a document (posexplode). The n-grams of
higher orders are the word with those that follow it, by a window's lead() over the
positions of a document; order 1 needs no window and therefore no shuffle. Features are
hashed into buckets and counted twice: over all documents and over the target texts. A
bucket's gain is how much likelier the target is to hold it. The gains, one row for each
bucket, are joined by broadcast, as their number is a parameter, and the sum over a
document's features is its weight, most of it within the task that read the document.

Gumbel noise of a hash of the id makes the highest scores a sample without replacement.
The ranks of the sample come from a sort by range and the counts of its partitions, so
no task sees more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.llm.common import materialise, session

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Values of the four hexadecimal bytes that noise is made from.
_DRAWS = 4294967296


def words_of(text: Column) -> Column:
    """Runs of letters and digits of ASCII, A-Z lower-cased, and of all beyond ASCII; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORDS), F.lit(0))


def position_table(texts: DataFrame, *keys: str) -> DataFrame:
    """The keys, at and word: a row for each word, and one without a word for a text that has none."""
    return texts.select(*keys, F.posexplode_outer(words_of(F.col("text"))).alias("at", "word"))


def features(positions: DataFrame, key: str, orders: int) -> DataFrame:
    """positions with gram: a row for each run of 1 to orders words within one value of key."""
    if orders == 1:
        return positions.withColumn("gram", F.col("word"))
    following = Window.partitionBy(key).orderBy("at")
    words = [F.col("word"), *(F.lead("word", k).over(following) for k in range(1, orders))]
    joined = [words[0]]
    for k in range(1, orders):
        joined.append(F.concat(joined[-1], F.lit(" "), F.col(f"_lead{k}")))  # null where the text ends
    placed = positions.withColumns({f"_lead{k}": words[k] for k in range(1, orders)})
    each = placed.withColumn("_grams", F.array(*joined)).select(*positions.columns, F.posexplode("_grams").alias("_order", "gram"))
    return each.where("_order = 0 or gram is not null").drop("_order")


def _hashed(texts: DataFrame, orders: int, buckets: int, *keys: str) -> DataFrame:
    """The keys, bucket (null for a text without words) and first, whether the feature is a single word, for each feature."""
    found = features(position_table(texts, *keys), keys[0], orders)
    return found.select(*keys, F.pmod(F.crc32("gram"), F.lit(buckets)).cast("int").alias("bucket"), (F.col("gram") == F.col("word")).alias("first"))


def _counts(texts: DataFrame, orders: int, buckets: int, name: str) -> DataFrame:
    numbered = texts.select(F.monotonically_increasing_id().alias("_row"), "text")
    return _hashed(numbered, orders, buckets, "_row").where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, *, orders: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, gain: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), for each bucket that a document has.

    s and t count the bucket's features in docs and target, S and T all of them. At most
    as many rows as buckets.
    """
    s = materialise(_counts(docs, orders, buckets, "s"), "buckets")
    t = materialise(_counts(target, orders, buckets, "t"), "buckets")
    totals = s.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("s_all")).crossJoin(t.agg(F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("t_all")))
    both = s.join(t, "bucket", "left").crossJoin(F.broadcast(totals))  # totals: one row
    ratio = (F.coalesce("t", F.lit(0)).cast("double") + 1) * (F.col("s_all") + buckets) / ((F.col("s").cast("double") + 1) * (F.col("t_all") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def importance(docs: DataFrame, target: DataFrame, *, orders: int = 1, buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of docs.

    weight sums the gains of a document's features, each as often as it occurs, and is 0
    without any. score adds Gumbel noise from seed and doc_id, a null doc_id being empty.
    Null texts have no words. Repeated rows of docs give repeated rows, and count as
    often. Without target texts all gains speak against frequent features alone. Columns
    other than doc_id and text are not read.
    """
    session(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    gains = materialise(bucket_gains(docs, target, orders=orders, buckets=buckets), "gains")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    met = _hashed(rows, orders, buckets, "_row", "doc_id").join(F.broadcast(gains), "bucket", "left")
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    summed = met.groupBy("_row", "doc_id").agg(some(F.sum(F.col("first").cast("long"))).alias("n_words"), F.count("bucket").alias("n_features"), some(F.sum("gain")).alias("weight"))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / _DRAWS)))
    return summed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def ranked(scored: DataFrame, percent: int, *, least_words: int = 20) -> DataFrame:
    """scored with rank: 1, 2, 3... of the floor(percent * N / 100) highest scores of the N rows of least_words or more, else null.

    Equal scores go by the smaller doc_id, rows without one last, then by n_features.
    """
    scored = materialise(scored, "scored")
    fits = scored.where(F.col("n_words") >= least_words)
    drawn = fits.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    sorted_ = fits.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = materialise(sorted_, "sorted")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted_.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["count"]
    offsets = scored.sparkSession.createDataFrame(starts, "_part long, _before long")
    placed = sorted_.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    rank = F.col("_before") + place + 1
    chosen = placed.select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))
    return chosen.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resampling(docs: DataFrame, target: DataFrame, *, percent: int = 10, orders: int = 1, buckets: int = 10_000, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of each row of docs; see importance and ranked."""
    scored = importance(docs, target, orders=orders, buckets=buckets, seed=seed)
    return ranked(scored, percent, least_words=least_words).drop("n_words")
