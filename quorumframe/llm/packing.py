"""Packing of documents along a space-filling curve.

A document's bag of token ids, hashed to signs, is projected to a few dimensions
and quantised; its place on the Hilbert curve through them is its key. Documents
are range-sorted by key and their ids laid end to end along the curve, so that
those that lie close share sequences. Sequences are cut from this line at every
length tokens: only the last one can be padded.

Ids are shuffled once; what is sorted has one small row for each document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.llm.common import materialise
from quorumframe.llm.tokens import grouped, tokenizer

_DIMENSIONS, _BITS = 4, 15
_ONES = np.ones(1 << 12)


def hilbert_key(points: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates below 2**bits."""
    x = points.T.astype(np.uint64).copy()
    n, one = len(x), np.uint64(1)
    level = one << np.uint64(bits - 1)
    while level > one:  # undo the turns of the curve from the coarsest level down
        low = level - one
        for i in range(n):
            turned = (x[i] & level) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        level >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = one << np.uint64(bits - 1)
    while level > one:
        flip ^= np.where((x[n - 1] & level) != 0, level - one, np.uint64(0))
        level >>= one
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(bit) & one)
    return key.astype(np.int64)


@lru_cache(maxsize=2)
def _directions(ids: int) -> np.ndarray:
    """A fixed direction for each token id, by a multiplicative hash."""
    hashed = (np.arange(1, ids * _DIMENSIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (hashed.astype(np.float64) / (1 << 23) - 1).reshape(ids, _DIMENSIONS)


def projected(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """The document's direction, quantised to _BITS bits a dimension; the middle if it is empty."""
    total, directions = np.zeros(_DIMENSIONS), _directions(vocabulary)
    for at in range(0, len(ids), 1 << 12):  # directions are multiples of 2**-23, so sums are exact in any order
        part = ids[at : at + (1 << 12)]
        total += _ONES[: len(part)] @ directions.take(part, axis=0)
    norm = np.linalg.norm(total)
    unit = total / norm if norm else total
    return np.minimum((unit + 1) / 2 * (1 << _BITS), (1 << _BITS) - 1).astype(np.uint64)


def _encoding(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        vocabulary, wide = encoder.tokenizer.get_vocab_size(), encoder.dtype.itemsize
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            encoded, places = [], []
            for texts in grouped(batch["text"].to_pylist()):
                for ids in encoder.encode(texts):
                    places.append(projected(np.frombuffer(ids, encoder.dtype), vocabulary))
                    encoded.append(ids + end)
            keys = hilbert_key(np.array(places).reshape(-1, _DIMENSIONS))
            counts = np.array([len(e) // wide for e in encoded], np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(keys), pa.array(counts), pa.array(encoded, pa.binary()), pa.array(np.full(len(keys), wide, np.int32))], ["doc_id", "key", "n", "ids", "width"])

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        counts = batch["n"].to_numpy()
        upto = before + np.cumsum(counts)
        yield pa.RecordBatch.from_arrays([batch["row"], batch["n"], pa.array(np.full(len(counts), part, np.int32)), pa.array(upto - counts)], ["row", "n", "part", "before"])
        before = int(upto[-1]) if len(upto) else before


def _cutting(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ids, width, place in zip(*(batch[c].to_pylist() for c in ("doc_id", "ids", "width", "place"))):
                tokens = np.frombuffer(ids, f"<u{width}").astype("<u4")
                start = 0
                while start < len(tokens):
                    sequence, offset = divmod(place + start, length)
                    end = min(len(tokens), start + length - offset)
                    rows.append((doc_id, start, end - start, zlib.crc32(tokens[start:end].tobytes()), len(tokens), sequence, offset))
                    start = end
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of length tokens.

    One row for each piece: doc_id, start (ids of its document before it), length,
    ids_crc32, doc_tokens, sequence_id and offset (tokens of the sequence before it).
    Null and empty texts hold end_id alone. Repeated rows and null doc_ids are packed
    like any other; ties along the curve go by doc_id, then by place in the input. An
    empty table has no pieces.
    """
    spark = docs.sparkSession
    encoded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoding(tokenizer_path, end_id), "doc_id long, key long, n long, ids binary, width int")
    encoded = materialise(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    curve = encoded.select("row", "doc_id", "key", "n").repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    walked = materialise(curve.mapInArrow(_walk, "row long, n long, part int, before long"), "curve")
    totals = sorted((r["part"], r["total"]) for r in walked.groupBy("part").agg(F.sum("n").alias("total")).collect())
    bases = list(zip((p for p, _ in totals), accumulate((t for _, t in totals), initial=0)))
    placed = walked.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select("row", (F.col("base") + F.col("before")).alias("place"))
    pieces = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return encoded.select("row", "doc_id", "ids", "width").join(placed, "row").select("doc_id", "ids", "width", "place").mapInArrow(_cutting(length), pieces)
