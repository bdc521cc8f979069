import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quorumframe.llm.copies import exact_duplicates, unlike_texts


def brute(rows, largest=True):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        stays = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            own = not stays and i == keep
            stays |= own
            out.append((i, keep, len(ids), own, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("block_bytes", [1, 2_000, 32 << 20])
def test_exact_duplicates_equal_brute_force(spark, largest, block_bytes):
    draw = random.Random(7)
    texts = ["a", "A", "a ", "", None, "é", "é", "x" * 300_000, "x" * 300_000 + "y", *(f"text {k}" for k in range(20))]
    rows = [(k, draw.choice(texts)) for k in range(600)] + [(1000 + k, "hot") for k in range(400)]
    rows += [(7, "twice"), (7, "twice"), (None, "twice"), (None, "nobody"), (None, "nobody"), (-5, "below"), (-6, "below")]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, digest string, block int").repartition(7)
    got = exact_duplicates(docs, largest=largest, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, largest)


def test_texts_with_one_digest_stay_apart(spark):
    rows = [(k, f"text {k % 11}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = unlike_texts(docs, block_bytes=500, digest=lambda text: bytes([len(text)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((k, t) for k, t in rows if k >= 289)


def test_rows_stay_as_they_are(spark):
    docs = spark.createDataFrame([(1, None, "own", 5), (2, "", "x", 6), (3, "b", None, None)], "doc_id int, text string, own string, digest int")
    kept = unlike_texts(docs)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == [(2, "", "x", 6), (3, "b", None, None)]
    none = docs.where("false")
    assert exact_duplicates(none).count() == 0 and unlike_texts(none).count() == 0
    alone = exact_duplicates(docs.where("doc_id = 3")).first()
    assert (alone.keep_id, alone.group_size, alone.kept) == (3, 1, True)


def test_text_of_a_third_of_all_rows_is_dealt_over_salts(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 5_000)).alias("text")).repartition(8)
    row = exact_duplicates(docs, block_bytes=40_000).where("text_sha256 = sha2('hot', 256)").agg(F.count("*"), F.sum(F.col("kept").cast("int")), F.max("keep_id"), F.min("group_size")).first()
    assert tuple(row) == (20_000, 1, 59_997, 20_000)
