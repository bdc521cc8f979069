"""Alignments against all ways to pair entries without crossing."""

import random
from itertools import combinations

import pytest

from quorumframe.operators.alignment import aligned, best_pairs


def likeness(a, b):
    return len(a & b) / len(a | b) if a & b else 0.0


def exhaustive(left, right, least):
    best = 0.0
    for k in range(1, min(len(left), len(right)) + 1):
        for rows in combinations(range(len(left)), k):
            for columns in combinations(range(len(right)), k):
                likes = [likeness(left[i], right[j]) for i, j in zip(rows, columns)]
                if min(likes) >= least:
                    best = max(best, sum(likes))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_best_pairs_are_the_best(seed):
    draw = random.Random(seed)
    entry = lambda: set(draw.sample("abcdef", draw.randrange(0, 4)))
    left, right = [entry() for _ in range(draw.randrange(0, 6))], [entry() for _ in range(draw.randrange(0, 6))]
    pairs = best_pairs(left, right, 0.3, None)
    assert abs(sum(s for *_, s in pairs) - exhaustive(left, right, 0.3)) < 1e-9
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:])) and all(s == likeness(left[i], right[j]) for i, j, s in pairs)


def test_lost_headings_are_placed_between_their_neighbours(spark):
    agenda = [("a", 1, ["acta", "sesion"]), ("a", 2, ["mocion", "ria"]), ("a", 3, ["mocion", "metro"]), ("a", 4, ["ruegos"]), ("a", 5, None), ("b", 1, ["sola"]), (None, 1, ["nadie"])]
    body = [("a", 100, ["acta", "sesion", "anterior"]), ("a", 250, ["otra", "cosa"]), ("a", 300, ["mocion", "metro"]), ("c", 1, ["acta"])]
    frames = [spark.createDataFrame(rows, "doc string, at int, words array<string>") for rows in (agenda, body)]
    got = {(r.doc, r.at): (r.other, round(r.score, 2) if r.score else None, r.after, r.before) for r in aligned(*frames, "doc").collect()}
    assert got == {("a", 1): (100, 0.67, None, None), ("a", 2): (None, None, 100, 300), ("a", 3): (300, 1.0, None, None), ("a", 4): (None, None, 300, None), ("a", 5): (None, None, 300, None), ("b", 1): (None, None, None, None), (None, 1): (None, None, None, None)}
    assert aligned(frames[0].where("false"), frames[1], "doc").count() == 0


def test_a_band_leaves_far_partners_out():
    left, right = [{"x"}, *({f"n{k}"} for k in range(9))], [*({f"m{k}"} for k in range(9)), {"x"}]
    assert len(best_pairs(left, right, 0.3, None)) == 1 and best_pairs(left, right, 0.3, 3) == []
