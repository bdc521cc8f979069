import random

import numpy as np
import pytest

from quorumframe.operators.components import components
from quorumframe.llm.simhash import fingerprint, near_duplicates, near_links, split_leaves


def _groups(points: list[int], links) -> set[frozenset]:
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    by = {}
    for p in points:
        by.setdefault(find(p), set()).add(p)
    return {frozenset(g) for g in by.values()}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("segments", [1, 2, 4])
def test_links_equal_brute_force(spark, segments):
    draw = random.Random(7)
    points = {draw.getrandbits(64) for _ in range(300)}
    for p in list(points)[:60]:
        for _ in range(draw.randrange(1, 6)):  # chains of near copies, at 1 to 4 bits
            for bit in draw.sample(range(64), draw.randrange(1, 5)):
                p ^= 1 << bit
            points.add(p)
    points |= {(1 << k) - 1 for k in range(40)}  # a long chain
    points = sorted(points)
    exact = _groups(points, [(a, b) for i, a in enumerate(points) for b in points[i + 1 :] if (a ^ b).bit_count() <= 3])
    df = spark.createDataFrame([(_signed(p),) for p in points], "fp long")
    found = [(r.u % (1 << 64), r.v % (1 << 64)) for r in near_links(df, leaf_points=16, segments=segments).collect()]
    assert len(found) < segments * len(points) * 4
    assert _groups(points, found) == exact


@pytest.mark.parametrize("segments", [1, 2])
def test_leaves_keep_their_bound_and_lose_no_pair(spark, segments):
    """Points that no tree was fitted on, many with a whole segment in common, all in one leaf at first."""
    draw = random.Random(11)
    points = {draw.getrandbits(64) for _ in range(300)} | {draw.getrandbits(32) << 32 | 0xABCD1234 for _ in range(300)} | {draw.getrandbits(32) | 0x77770000 << 32 for _ in range(200)}
    for p in list(points)[:200]:
        for bit in draw.sample(range(64), draw.randrange(1, 4)):
            p ^= 1 << bit
        points.add(p)
    dealt = spark.createDataFrame([(k, 0, _signed(p), True) for k in range(segments) for p in points], "tree int, leaf long, fp long, home boolean")
    leaves = {}
    for r in split_leaves(dealt, reach=3, segments=segments, most=40).collect():
        leaves.setdefault((r.tree, r.leaf), []).append((r.fp % (1 << 64), r.home))
    assert max(sum(home for _, home in own) for own in leaves.values()) <= 40 and len(leaves) > 20
    for k in range(segments):  # every point is at home in one leaf of each tree
        assert sorted(p for (tree, _), own in leaves.items() if tree == k for p, home in own if home) == sorted(points)
    ordered = sorted(points)
    exact = {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 3}
    met = {(min(a, b), max(a, b)) for own in leaves.values() for a, home in own if home for b, _ in own if a != b and (a ^ b).bit_count() <= 3}
    assert met == exact and len(exact) > 100


def test_visitors_of_a_crowded_leaf_go_to_chunks(spark):
    from quorumframe.llm.simhash import _with_chunks

    dealt = spark.createDataFrame([(0, 1, k, k < 5) for k in range(105)] + [(0, 2, k, True) for k in range(4)], "tree int, leaf long, fp long, home boolean")
    chunks = {}
    for r in _with_chunks(dealt, 30).collect():
        chunks.setdefault((r.leaf, r.chunk), []).append(r)
    assert len([c for c in chunks if c[0] == 1]) == 4 and all(sum(r.home for r in own) == 5 for (leaf, _), own in chunks.items() if leaf == 1)
    assert sum(not r.home for own in chunks.values() for r in own) == 100 and len(chunks[2, 0]) == 4


def test_components(spark):
    edges = [(5, 1), (1, 9), (9, 2), (7, 7), (20, 21), (21, 20)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in (1, 2, 5, 9)} == {1} and got[21] == 20 and 7 not in got
    assert {got[k] for k in range(100, 160)} == {100} and {got[k] for k in range(200, 261)} == {200}
    star = spark.range(1, 30_000).selectExpr("0 as u", "id as v").union(spark.range(50_000, 50_400).selectExpr("id as u", "id + 1 as v"))  # a node that very many edges have
    assert {tuple(r) for r in components(star).groupBy("component").count().collect()} == {(0, 30_000), (50_000, 401)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark):
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    rows = [(3, "A b c d"), (1, "a B\tc  d"), (2, None), (4, ""), (5, " \n"), (6, long), (7, long), (9, "x"), (9, "x"), (None, "x")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()]
    by = {k: (f, c) for k, f, c in got}
    assert len(got) == len(rows)
    assert by[1] == by[3] and by[1][1] == 1
    assert by[2] == by[4] == by[5] == ("0" * 16, 2)
    assert by[6] == by[7] and by[7][1] == 6 and by[None][1] == 9
    assert near_duplicates(docs.where("false")).count() == 0


def test_fingerprint_is_the_majority_of_shingle_hashes():
    import xxhash

    text = "one two three four TWO three\x0bfour"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    expected = sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))
    assert fingerprint(text.encode()) == expected
    assert fingerprint(b"Ab") == xxhash.xxh64_intdigest("ab", 42) and fingerprint(None) == 0
    assert np.uint64(fingerprint(b"q w e")) == xxhash.xxh64_intdigest("q w e", 42)
