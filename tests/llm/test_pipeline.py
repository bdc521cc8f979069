from itertools import combinations

import public_tokenizers

import corpus_pipeline
from quorumframe.llm.minhash import shingles
from quorumframe.llm.simhash import near_duplicates, one_of_each


def test_one_of_each(spark):
    rows = [(5, "a b c d"), (3, "A b c d"), (3, "A b c d"), (9, "other words are here"), (7, None), (6, ""), (None, "lonely text of nobody"), (None, "lonely text of nobody"), (9, "other words are here now"), (None, "a b c d")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(docs).collect()), key=str)
    components = {(r.fingerprint) for r in near_duplicates(docs).collect()}
    assert (3, "A b c d") in kept and kept.count((3, "A b c d")) == 1 and (5, "a b c d") not in kept
    assert (None, "lonely text of nobody") in kept and (6, "") in kept and (7, None) not in kept
    assert len(kept) <= len(components)
    single = spark.createDataFrame([(1, "x y z", "en", "s", 1), (2, "x y z", "en", "s", 1)], docs.schema)
    assert [r.doc_id for r in one_of_each(single).collect()] == [1] and one_of_each(single.where("false")).count() == 0


def test_stages_one_by_one(spark):
    """Each stage against a plain reading of what it must do with its own input."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from quorumframe.llm.decontaminate import contamination
    from quorumframe.llm.toxicity import toxicity

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    first = stages["toxicity"](spark, docs, folder)
    rejected = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in first.collect()} == ids - rejected and first.columns == list(corpus_pipeline.COLUMNS)
    second = stages["near_duplicates"](spark, first, folder)
    sets = {r.doc_id: set(shingles((r.text or "").encode()).tolist()) for r in first.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):  # every pair of documents, by the similarity itself
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            one, other = find(a), find(b)
            root[max(one, other)] = min(one, other)
    assert {r.doc_id for r in second.collect()} == {find(i) for i in sets}
    third = stages["decontamination"](spark, second, folder)
    leaked = {r.doc_id for r in contamination(second, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - leaked
    fourth = stages["personal_data"](spark, third, folder)
    assert fourth.count() == third.count() and all(r.n_chars == len(r.text) for r in fourth.collect())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in fourth.collect())
    assert sum(r.length for r in corpus_pipeline.run(spark, folder).collect()) == total


def test_run_is_its_stages_in_order(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    key = lambda r: tuple(r.asDict().items())
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, docs.collect()))


def test_stages_take_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "of nobody"), (3, "mail a.b@c.dd now"), (3, "mail a.b@c.dd now"), (4, "x " * 50_000)]
    clashing = "_met int, _row int, fp int, score int, text_hash string, spans string, key long"
    docs = spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4, "h", "s", 5) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clashing}")
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        kept = out.collect()
        if name == "near_duplicates":
            assert sorted((r.doc_id for r in kept), key=str) == [1, 3, 4, None]
        elif name == "personal_data":
            assert sorted(str(r.text) for r in kept if r.doc_id == 3) == ["mail [email] now"] * 2 and len(kept) == len(rows)
        elif name == "packing":
            assert {r.doc_id for r in kept} == {1, 2, 3, 4, None}
        else:
            assert len(kept) == len(rows)
        assert stage(spark, docs.where("false"), folder).count() == 0
