"""Exact nearest neighbours, thresholds, reranking and prototypes over embedding columns.

Queries or prototypes are a stated, bounded set: they go to the executors in blocks,
and all vectors stream past them. A task keeps k rows for each query only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two numeric arrays, as an expression; null if either is zero or null."""
    a, b = (F.transform(F.col(x) if isinstance(x, str) else x, lambda v: v.cast("double")) for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Vectors that a task compares with its queries at once.
_SLICE = 512


def _matrices(column: pa.Array | list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the unit vectors of the rows that have it, and where they stand; null, empty and zero vectors are left out."""
    rows: dict[int, list[int]] = {}
    vectors = column.to_pylist() if isinstance(column, pa.Array) else column
    for k, v in enumerate(vectors):
        if v:
            rows.setdefault(len(v), []).append(k)
    out = {}
    for width, own in rows.items():
        data = np.array([vectors[k] for k in own], np.float64)
        norms = np.linalg.norm(data, axis=1)
        if (norms > 0).any():
            out[width] = data[norms > 0] / norms[norms > 0, None], np.array(own, np.int64)[norms > 0]
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def _scanning(block, k: int, at_most: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = block.value
        kept: list[list[tuple[float, int]]] = [[] for _ in ids]
        worst = np.full(len(ids), np.inf)  # of k kept; what is further away is none of them
        for batch in _slices(batches):
            every = batch["vec_id"].to_numpy(zero_copy_only=False)
            for width, (data, at) in _matrices(batch["embedding"]).items():
                if width not in asked:  # no query has this length
                    continue
                queries, numbers = asked[width]
                own, distances = every[at], 1.0 - queries @ data.T
                near = distances <= worst[numbers, None]
                if at_most is not None:
                    near &= distances < at_most
                for row in np.flatnonzero(near.any(axis=1)).tolist():
                    q, found = int(numbers[row]), np.flatnonzero(near[row])
                    kept[q] = sorted([*kept[q], *zip(distances[row, found].tolist(), own[found].tolist())])[:k]
                    if len(kept[q]) == k:
                        worst[q] = kept[q][-1][0]
        for at in range(0, len(ids), _SLICE):
            rows = [(int(i), int(v), d) for i, top in zip(ids[at : at + _SLICE], kept[at : at + _SLICE]) for d, v in top]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "distance"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int, at_most: float | None = None, block_queries: int = 2000) -> DataFrame:
    """query_id, vec_id, distance (one minus cosine) and rank of the k nearest to each query; ties go by vec_id.

    Both have vec_id and embedding. With at_most only rows below this distance count.
    A query meets the vectors that are as long as it is; null, empty and zero vectors are
    near nothing.
    """
    spark, parts = vectors.sparkSession, None
    blocks = max(1, -(-queries.count() // block_queries))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "embedding").orderBy("vec_id").collect()  # one block
        block = spark.sparkContext.broadcast(([r["vec_id"] for r in rows], _matrices([r["embedding"] for r in rows])))
        found = vectors.select("vec_id", "embedding").mapInArrow(_scanning(block, k, at_most), "query_id long, vec_id long, distance double")
        parts = found if parts is None else parts.unionByName(found)
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _assigning(block, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = block.value
        for batch in _slices(batches):
            labels, values = [None] * batch.num_rows, [None] * batch.num_rows
            for width, (data, at) in _matrices(batch["embedding"]).items():
                if width not in prototypes:
                    continue
                own, numbers = prototypes[width]
                scores = data @ own.T
                best = scores.argmax(axis=1)
                for row, k, score in zip(at.tolist(), best.tolist(), scores[np.arange(len(at)), best].tolist()):
                    if score >= least:
                        labels[row], values[row] = names[numbers[k]], score
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(labels, pa.string()), pa.array(values, pa.float64())], ["vec_id", "prototype", "score"])

    return run


def assign_prototypes(vectors: DataFrame, prototypes: DataFrame, *, least: float = 0.55, most_prototypes: int = 10_000) -> DataFrame:
    """vec_id with the name of its most similar prototype (name, embedding) and the score; null below least, or where no prototype is as long."""
    rows = prototypes.select("name", "embedding").orderBy("name").limit(most_prototypes + 1).collect()
    if len(rows) > most_prototypes:
        raise ValueError(f"more than {most_prototypes} prototypes")
    block = vectors.sparkSession.sparkContext.broadcast(([str(r["name"]) for r in rows], _matrices([r["embedding"] for r in rows])))
    schema = vectors.select("vec_id").schema.add("prototype", "string").add("score", "double")
    return vectors.select("vec_id", "embedding").mapInArrow(_assigning(block, least), schema)
