import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quorumframe.llm.resampling import importance, ranked, resampling


def grams(text, orders):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[k : k + n]) for n in range(1, orders + 1) for k in range(len(words) - n + 1)]


def brute(docs, target, orders, buckets, percent, least_words):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(map(bucket, grams(text, orders)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc_id, text in docs:
        words, own = grams(text, orders)
        weight = sum(gain(bucket(g)) for g in own)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    fits = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fits):
        r.append(k + 1 if k < len(fits) * percent // 100 else None)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in out), key=str)


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_resampling_equals_brute_force(spark, orders):
    draw = random.Random(5)
    vocabulary = ["the", "The", "of", "ñandú", "x1", "B2b", "ciónes", "zwölf", "a", "语言", "é"]
    said = lambda n: "".join(draw.choice(vocabulary) + draw.choice([" ", ", ", "-", "\n", "_", "\x00"]) for _ in range(n))
    docs = [(k, said(draw.randrange(0, 60))) for k in range(200)] + [(300, None), (301, ""), (302, " .,;"), (None, said(30)), (5, said(40)), (7, "same " * 30), (7, "same " * 30), (400, "long word " * 20_000)]
    target = [said(40) for _ in range(5)] + [None, "", "only in the target"]
    made = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, bucket int, word string").repartition(5)
    wanted = spark.createDataFrame([(k, x, 3) for k, x in enumerate(target)], "item_id long, text string, gain int")
    got = resampling(made, wanted, percent=10, orders=orders, buckets=97).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target, orders, 97, 10, 20)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (2, "c " * 25)], "doc_id long, text string")
    none = docs.where("false")
    assert resampling(none, docs).count() == 0
    got = resampling(docs, none, percent=50).collect()
    assert sorted(map(tuple, got), key=str) == brute([(1, "a b " * 20), (2, "c " * 25)], [], 1, 10_000, 50, 20)
    assert {r.rank for r in got} == {1, None}


def test_ranks_are_whole_over_many_partitions(spark):
    scored = spark.range(20_000).selectExpr("id AS doc_id", "20 + id % 3 AS n_words", "id % 7 AS n_features", "id AS weight", "id % 50 AS score").repartition(9)
    rows = ranked(scored, 37).where("rank is not null").orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, 7_401))
    assert [(-r.score, r.doc_id) for r in rows] == sorted((-(k % 50), k) for k in range(20_000))[:7_400]
    assert importance(scored.limit(0).selectExpr("doc_id", "'' AS text"), scored.limit(0).selectExpr("'' AS text")).count() == 0
