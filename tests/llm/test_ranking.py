import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quorumframe.llm.ranking import Chunk, _quantised, ranked_search


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in counts:
            m = 10 + 90 * c.total() * n_docs // total if c else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if score > 0 and doc_id is not None:
                found.append((-score, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk_docs", "block_terms", "cells"), [(4096, 500_000, 1 << 20), (16, 40, 64), (1, 1, 1)])
def test_search_equals_brute_force(spark, chunk_docs, block_terms, cells):
    draw = random.Random(11)
    words = ["the", "The", "of", "ñandú", "x1", "B2b", "语言", "é", *(f"w{k}" for k in range(60))]
    said = lambda n: "".join(words[min(int(draw.expovariate(0.1)), len(words) - 1)] + draw.choice([" ", ", ", "-", "\n", "_", "\x00"]) for _ in range(n))
    docs = [(k, said(draw.randrange(0, 50))) for k in range(150)]
    docs += [(500 + k, "of the ñandú copied everywhere x1 w3") for k in range(60)] + [(300, None), (301, ""), (302, " .,;"), (None, said(30)), (7, said(9)), (7, "the the"), (7, "the the"), (400, "long the " * 30_000)]
    items = [(k, said(12)) for k in range(8 if chunk_docs > 1 else 3)] + [(3, said(5)), (None, "the w1"), (90, None), (91, ""), (92, "nowhere to be found"), (93, "The THE the")]
    made = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, terms string").repartition(3)
    wanted = spark.createDataFrame([(*i, 2) for i in items], "item_id int, text string, score int")
    got = ranked_search(made, wanted, chunk_docs=chunk_docs, block_terms=block_terms, cells=cells).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 10)
    if chunk_docs > 100:
        none = made.where("false")
        assert ranked_search(none, wanted).count() == 0 and ranked_search(made, wanted.where("false")).count() == 0
        assert ranked_search(made.where("doc_id in (300, 301, 302)"), wanted).count() == 0


def test_bounds_hold_every_score():
    draw = np.random.default_rng(1)
    docs, terms = 300, 40
    tf, held = draw.integers(1, 30, (terms, docs)), draw.random((terms, docs)) < 0.3
    m = draw.integers(10, 3000, docs)
    at = [np.flatnonzero(held[t]) for t in range(terms)]
    flat, tfs = np.concatenate(at), np.concatenate([tf[t][at[t]] for t in range(terms)])
    byte = _quantised(tfs, m[flat])[1]
    assert byte.min() >= 1 and byte.max() <= 255
    chunk = Chunk({"doc_ids": range(docs), "terms": range(terms), "starts": np.concatenate([[0], np.cumsum([len(a) for a in at])]), "docs": flat, "bytes": byte.astype(np.uint8).tobytes(), "tfs": tfs, "lengths": m})
    asked, weights = [np.arange(0, 20), np.arange(10, 40, 3)], draw.integers(0, 9000, terms)
    upper, lower = chunk.bounds(asked, weights)
    for k, own in enumerate(asked):
        exact = chunk.exact(own, weights, np.ones(docs, bool))
        assert (lower[k] <= exact).all() and (exact <= upper[k]).all() and ((upper[k] - lower[k]) <= 3922 * weights[own].sum()).all()
