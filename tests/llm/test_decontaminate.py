import hashlib
import random
import re

from quorumframe.llm.common import hot_join
from quorumframe.llm.decontaminate import Bloom, contamination, cut, without_contaminated


def brute(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, owners = set(), set()
    for item, said in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), said or ""))
        size = min(window, len(own))
        for k in range(len(own) - size + 1) if own else ():
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[k : k + size]:
                    hit.update(range(at, at + size))
                    owners.add(item)
    named = ",".join(sorted(str(o) for o in owners if o is not None))  # items without an id are one, which has no name
    return len(words), len(hit), len(owners), hashlib.sha256(named.encode()).hexdigest(), bool(hit)


def test_equals_brute_force(spark):
    draw = random.Random(4)
    vocabulary = ["a", "b", "c", "Dd", "é", "7", "x-y", "Ünder"]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 4, 5, 9])))) for k in range(30)] + [(100, None), (101, ""), (102, "!"), (103, "a b c é 7"), (104, "a b c é 7"), (103, "a b c é 7"), (None, "x y Dd b b"), (None, "7 Ünder é é"), (104, "x")]
    docs = [(k, " ".join(draw.choices(vocabulary, k=draw.randrange(0, 60)))) for k in range(80)] + [(200, None), (201, ""), (3, "a"), (None, "a b c é 7"), (202, "zz " * 100_000 + "A, b; C é 7 zz")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n_hit string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    expected = sorted(((doc, *brute(text, items, 4)) for doc, text in docs if doc != 202), key=str)
    for size in (1 << 20, 8):  # the smaller filter lets nearly everything through
        got = contamination(d, i, window=4, filter_bytes=size)
        rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect() if r.doc_id != 202), key=str)
        assert rows == expected
        clean = without_contaminated(d, i, window=4, filter_bytes=size)
        assert clean.columns == d.columns
        assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((e[0] for e in expected if not e[-1]), key=str)
    only = contamination(d, i.where("item_id is null"), window=4)
    assert {(r.n_items, r.contaminated, r.items_sha256) for r in only.collect() if r.n_hit} == {(1, True, hashlib.sha256(b"").hexdigest())}
    assert without_contaminated(d, i.where("false")).count() == d.count()
    assert not any(r.contaminated for r in contamination(d, i.where("false")).collect())
    assert contamination(d.where("false"), i).count() == 0


def test_the_filter_lacks_nothing_it_was_given(spark):
    import numpy as np

    values = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 5000)
    own = spark.createDataFrame([(int(v),) for v in values[:2000]], "shingle long")
    bloom = Bloom.of(spark, own, 2000, 1 << 20)
    held = bloom.holds(values.view(np.uint64))
    assert held[:2000].all() and held[2000:].mean() < 0.05 and len(bloom.words) * 8 <= 1 << 20
    assert len(Bloom.of(spark, own, 2000, 64).words) * 8 == 64


def test_hot_keys_meet_their_facts_where_they_are(spark):
    rows = spark.range(60_000).selectExpr("id", "if(id % 3 = 0, 7, id % 1000) as key").union(spark.createDataFrame([(1, None)], "id long, key long"))
    facts = rows.groupBy("key").agg({"*": "count"}).selectExpr("key", "`count(1)` as n", "key * 2 as twice")
    for how in ("inner", "left"):
        got = hot_join(rows, facts.where("key is null or key <> 5"), "key", "n", how)
        plan = got._jdf.queryExecution().executedPlan().toString()
        expected = rows.join(facts.where("key is null or key <> 5").drop("n"), "key", how)
        assert sorted(map(str, got.select("id", "key", "twice").collect())) == sorted(map(str, expected.select("id", "key", "twice").collect())) and "BroadcastHashJoin" in plan


def test_words_and_shingles():
    import numpy as np
    import pyarrow as pa

    draw = random.Random(6)
    parts = ["a", "Bc", " ", "\n", "é", "x-y", "0", "ÅNGSTRÖM", "w" * 70, "", "longerwordthaneight", "🎉", "\0"]
    texts = [None, "", "!", *("".join(draw.choices(parts, k=draw.randrange(0, 20))) for _ in range(500)), "tail"]
    expected = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    hashes, pairs = {}, {}
    for low, words in [c for column in (pa.array(texts), pa.array(["x y", *texts])[1:]) for c in cut(column)]:
        for k, (begun, ended) in enumerate(zip(words.first[:-1], words.first[1:])):
            own = expected[low + k]
            assert (words.said(begun, ended).split(" ") if ended > begun else []) == own
            for w, h in zip(own, words.hashes[begun:ended].tolist()):
                assert hashes.setdefault(w, h) == h
        values, at = words.shingles(2)
        for value, k in zip(values.tolist(), at.tolist()):
            assert pairs.setdefault(words.said(k, k + 2), value) == value
        assert len(at) == sum(max(0, len(w) - 1) for w in expected[low : low + len(words.first) - 1])
    assert len(set(hashes.values())) == len(hashes) and len(set(pairs.values())) == len(pairs)
