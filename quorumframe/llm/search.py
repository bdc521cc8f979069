"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's bits are cut into segments, and an index keeps one table for each
segment. Codes as wide as the vectors are. Codes within distance m * (r + 1) - 1 of a query differ from it by at
most r bits in at least one of the m segments, so after the tables have been
probed with all values within r bits, everything up to that distance has been
verified. A query's radius grows until its k-th verified distance is covered.

Equal codes meet first, and of each only the k smallest ids can be needed. Spark
deals distinct codes to tasks, which index them in bounded chunks, each of which answers
a whole block of queries. A block is bounded by its bytes, and as a code has a few, it
holds millions of queries; all codes are read and indexed once for each block. A chunk
gives at most k rows for a query, and their best are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.llm.common import hot_join, materialise

_WIDTH = 16
#: Parts that a code which very many vectors share is dealt to first.
_SALTS = 128
#: Queries whose answers leave a task together.
_ANSWERS = 10_000
_FLIPS = [np.array([sum(1 << b for b in bits) for bits in combinations(range(_WIDTH), r)], np.uint16) for r in range(_WIDTH + 1)]


def _coding(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for vector in batch["embedding"].to_pylist():
                own = np.zeros(bits, np.uint8)
                own[: len(vector)] = [x is not None and x > 0 for x in vector]
                codes.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(codes, pa.binary())], ["vec_id", "code"])

    return run


def code_bits(*tables: DataFrame) -> int:
    """Bits of a code that holds every number of the longest vector, in whole words of 64."""
    longest = [t.agg(F.max(F.size("embedding"))).first()[0] or 0 for t in tables]
    return max(64, -(-max(longest) // 64) * 64)


def binary_codes(vectors: DataFrame, bits: int) -> DataFrame:
    """vec_id, code: the signs of all numbers; missing, NaN or null numbers count as not positive."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).where("vec_id is not null and embedding is not null")
    return rows.mapInArrow(_coding(bits), "vec_id long, code binary")


def _words(codes: bytes, bits: int) -> np.ndarray:
    """A row of 64-bit words for each code of so many bits."""
    return np.frombuffer(codes, np.uint64).reshape(-1, bits // 64)


class MultiIndex:
    """Tables of one chunk of distinct codes, each with the ids that have it."""

    def __init__(self, codes: np.ndarray, members: list[list[int]]) -> None:
        self.codes, self.members, self.segments = codes, members, codes.shape[1] * 64 // _WIDTH
        self.sizes = np.array([len(m) for m in members])
        self.parts = np.ascontiguousarray(codes).view(np.uint16)
        self.order = [np.argsort(self.parts[:, s], kind="stable") for s in range(self.segments)]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(self.parts[:, s], minlength=1 << _WIDTH))]) for s in range(self.segments)]

    def _probe(self, segment: int, value: int, radius: int) -> np.ndarray:
        values = _FLIPS[radius] ^ np.uint16(value)
        starts, ends = self.starts[segment][values], self.starts[segment][values.astype(np.int64) + 1]
        sizes = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return self.order[segment][at]

    def top(self, code: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k nearest (distance, id)."""
        own = np.ascontiguousarray(code).view(np.uint16)
        met = np.zeros(len(self.codes), bool)
        found, distances, reach = np.zeros(0, np.int64), np.zeros(0, np.int64), self.codes.shape[1] * 64
        for radius in range(_WIDTH + 1):
            for s in range(self.segments):
                new = self._probe(s, int(own[s]), radius)
                new = new[~met[new]]
                met[new] = True
                found = np.concatenate([found, new])
            distances = np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=np.int64)
            order = np.argsort(distances, kind="stable")
            counted = np.cumsum(self.sizes[found[order]])
            if len(counted) and counted[-1] >= k:
                reach = int(distances[order[np.searchsorted(counted, k)]])
                if reach <= self.segments * (radius + 1) - 1:
                    break
        near = np.flatnonzero(distances <= reach)
        return sorted((int(distances[i]), m) for i in near for m in self.members[found[i]])[:k]


def _searching(block, bits: int, k: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _words(block.value, bits)

        def answers(codes, members):
            index = MultiIndex(_words(b"".join(codes), bits), members)
            for low in range(0, len(asked), _ANSWERS):
                flat = [(q.tobytes(), d, i) for q in asked[low : low + _ANSWERS] for d, i in index.top(q, k)]
                columns = list(zip(*flat)) if flat else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64()))], ["code", "distance", "vec_id"])

        codes, members = [], []
        for batch in batches:
            codes += batch["code"].to_pylist()
            members += batch["members"].to_pylist()
            if len(codes) >= chunk:
                yield from answers(codes, members)
                codes, members = [], []
        if codes:
            yield from answers(codes, members)

    return run


def _smallest(codes: DataFrame, k: int, *keys: str) -> DataFrame:
    return codes.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("n") <= k).drop("n")


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, chunk_codes: int = 500_000, block_bytes: int = 32 << 20) -> DataFrame:
    """The k vectors nearest to each query by the Hamming distance of their codes.

    Rows: query_id, rank (from 1), vec_id, distance; ties go by vec_id. The vector
    itself is among its neighbours. With fewer than k vectors all are returned.
    Rows without an id or vector take no part; repeated ids are separate vectors.
    Codes are as wide as the longest vector; what a shorter one lacks is not positive.
    block_bytes bounds the codes of queries that are sent to all tasks at once.
    """
    spark = vectors.sparkSession
    bits = code_bits(vectors, queries)
    codes = materialise(binary_codes(vectors, bits), "codes")
    few = _smallest(_smallest(codes.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS))), k, "code", "salt"), k, "code")
    index = materialise(few.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "index")
    asked = materialise(binary_codes(queries, bits).withColumnRenamed("vec_id", "query_id"), "queries")
    wanted = materialise(asked.groupBy("code").agg(F.count("*").alias("n")), "wanted")
    blocks = max(1, -(-wanted.count() * (bits // 8) // block_bytes))
    parts = spark.createDataFrame([], "code binary, distance int, vec_id long")
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("code"), F.lit(blocks)) == b).select("code").collect()  # about block_bytes of the stated queries
        if rows:  # hashes may leave a block empty
            block = spark.sparkContext.broadcast(b"".join(bytes(r["code"]) for r in rows))
            parts = parts.unionByName(index.mapInArrow(_searching(block, bits, k, chunk_codes), "code binary, distance int, vec_id long"))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    tops = best.groupBy("code").agg(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "vec_id", "distance")).alias("tops"))
    found = hot_join(asked, materialise(tops.join(wanted, "code"), "tops"), "code", "n")
    return found.select("query_id", F.explode("tops").alias("top")).select("query_id", "top.*")
