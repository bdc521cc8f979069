import random

import pytest

from quorumframe.llm.search import top_k


@pytest.mark.parametrize("width", [64, 20, 130])
def test_search_equals_brute_force(spark, width):
    draw = random.Random(2)
    base = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(40)]
    rows = [(k, [x + draw.gauss(0, 0.4) for x in base[k % 40]]) for k in range(1500)]
    rows += [(2000 + k, base[0]) for k in range(50)] + [(3000, None), (None, base[1]), (3001, []), (3002, [float("nan")] * width), (3003, base[0][: width // 2] + [-x for x in base[0][width // 2 :]]), (3100, base[2][:7])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, code int")
    codes = {k: sum(1 << at for at, x in enumerate(v) if x > 0) for k, v in rows if k is not None and v is not None}
    for chunk, block in ((10_000, 32 << 20), (100, 40), (700, 8)):
        got = {}
        for r in top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, chunk_codes=chunk, block_bytes=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.distance, r.vec_id))
        assert len(got) == sum(v % 100 == 0 for v in codes)
        for q, found in got.items():
            exact = sorted(((codes[q] ^ c).bit_count(), v) for v, c in codes.items())[:10]
            assert [(d, v) for _, d, v in sorted(found)] == exact
    few = vectors.where("vec_id < 3")
    assert top_k(few, few).count() == 9 and top_k(few, few.where("false")).count() == 0 and top_k(few.where("false"), few).count() == 0


def test_queries_of_empty_blocks_and_of_one_code(spark):
    vectors = spark.createDataFrame([(k, [1.0 if k >> b & 1 else -1.0 for b in range(8)]) for k in range(200)] + [(1000 + k, [1.0] * 8) for k in range(300)], "vec_id long, embedding array<float>")
    three = vectors.where("vec_id in (0, 100, 1001)")
    for block in (8, 16, 1 << 20):  # blocks of one code: some are left empty
        assert top_k(vectors, three, block_bytes=block).groupBy("query_id").count().collect() and top_k(vectors, three, block_bytes=block).count() == 30
    hot = top_k(vectors, vectors.where("vec_id >= 1000"), k=2).collect()
    assert len(hot) == 600 and {(r.rank, r.vec_id, r.distance) for r in hot} == {(1, 1000, 0), (2, 1001, 0)}
    none = vectors.where("false")
    assert top_k(vectors, none).collect() == [] and top_k(none, vectors).collect() == [] and top_k(none, none).collect() == []
