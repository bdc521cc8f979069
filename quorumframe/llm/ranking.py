"""Ranked lexical search on a two-level quantised index, exact to the last document.

The score of a document for an item sums, over the item's terms that it holds, a weight
(how rare the term is) times a share (how much of the document it is), all in integers.

The first level keeps one byte for each posting: its share in steps, rounded upward. So
a document's score is at most the sum of weight * byte * step, and more than that of
weight * (byte - 1) * step or equal to it. The second level keeps what the share is made
of. A task reads its part of the index in chunks, adds up bytes for all items at once,
takes the k-th largest lower bound of each item (or its k-th exact score so far, if that
is larger), and rescores exactly every document whose upper bound reaches it. What no
bound excludes is rescored, so nothing is lost; a task gives at most k rows for an item,
and the best of these are exact.

Only terms of the items are indexed. Items come in blocks of a bounded number of terms,
and documents are read once for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.llm.common import materialise, session
from quorumframe.llm.decontaminate import _TABLE

_SLICE_BYTES = 8 << 20
#: A share is below a million; a byte counts it in steps of this size.
_STEP = -(-1_000_000 // 255)


def words_of(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """For texts in slices of a bounded size or of one text: their words in order, and where those of each text begin and the last end.

    Words are runs of letters and digits of ASCII, A-Z lower-cased, and of all beyond ASCII.
    """
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _SLICE_BYTES, "right")) - 1)
        own, places = _TABLE[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        inside = own != 32
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        begun = places[:-1][places[:-1] < places[1:]]  # a text ends the word before it
        opens[begun] = inside[begun]
        letters, starts = own[inside], np.flatnonzero(opens)
        at = np.append(np.cumsum(inside)[starts] - 1, len(letters)).astype(np.int64)
        yield pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]), np.searchsorted(starts, places)
        low = high


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for words, first in words_of(batch["text"]):
            found += [pc.unique(words[b:e]).to_pylist() for b, e in zip(first[:-1].tolist(), first[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch["item"], batch["item_id"], pa.array(found, pa.list_(pa.binary()))], ["item", "item_id", "terms"])


def _counting(vocabulary: Broadcast):
    """doc_id, n (words) and the terms of the vocabulary in each document with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, terms, counts = [], [np.zeros(1, np.int64)], [], []
            for words, first in words_of(batch["text"]):
                sizes.append(np.diff(first))
                ids = pc.fill_null(pc.index_in(words, vocabulary.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                known = np.flatnonzero(ids >= 0)
                owner = np.searchsorted(first, known, "right") - 1
                keys, tf = np.unique(owner * len(vocabulary.value) + ids[known], return_counts=True)
                ends.append(ends[-1][-1] + np.searchsorted(keys, np.arange(1, len(first)) * len(vocabulary.value)))
                terms.append((keys % len(vocabulary.value)).astype(np.int32))
                counts.append(tf.astype(np.int32))
            joined = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
            offsets = pa.array(joined(ends, np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(joined(x, np.int32))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(joined(sizes, np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


_CHUNK = "doc_ids array<long>, terms array<int>, starts array<int>, docs array<int>, bytes binary, tfs array<int>, lengths array<long>"


def _quantised(tf: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of each posting, and its byte."""
    share = 1_000_000_000 * tf // (1000 * tf + 8 * m)
    return share, -(-share // _STEP)


def _indexing(n_docs: int, n_words: int, chunk_docs: int):
    """Chunks of the index: the documents, the postings by term with their bytes, and what the exact share needs."""

    def chunk(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        n, lists = rows["n"].to_numpy(), rows["terms"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy()
        docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        flat, tf = lists.flatten().to_numpy(), rows["tfs"].combine_chunks().flatten().to_numpy()
        order = np.argsort(flat, kind="stable")
        terms, starts = np.unique(flat[order], return_index=True)
        docs, tf = docs[order], tf[order]
        m = 10 + 90 * n * n_docs // n_words
        _, byte = _quantised(tf.astype(np.int64), m[docs])
        columns = [rows["doc_id"].to_numpy(), terms, np.append(starts, len(flat)).astype(np.int32), docs, None, tf, m]
        made = [pa.array([byte.astype(np.uint8).tobytes()], pa.binary()) if c is None else pa.array([c]) for c in columns]
        return pa.RecordBatch.from_arrays(made, ["doc_ids", "terms", "starts", "docs", "bytes", "tfs", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                held.append(part := batch.slice(at, chunk_docs - rows))
                at, rows = at + len(part), rows + len(part)
                if rows == chunk_docs:
                    yield chunk(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield chunk(pa.Table.from_batches(held))

    return run


@dataclass(frozen=True)
class Asked:
    """Items of a block: the terms of each, and the weight of each term."""

    items: list[int]
    terms: list[np.ndarray]
    weights: np.ndarray


class Chunk:
    """One chunk of the index, as arrays by term."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = np.array(row["doc_ids"], np.int64)
        self.docs, self.tf = np.array(row["docs"], np.int64), np.array(row["tfs"], np.int64)
        self.m = np.array(row["lengths"], np.int64)
        self.bytes = np.frombuffer(row["bytes"], np.uint8).astype(np.int64)
        starts = np.array(row["starts"], np.int64).tolist()
        self.places = {t: slice(b, e) for t, b, e in zip(np.array(row["terms"]).tolist(), starts[:-1], starts[1:])}

    def bounds(self, terms: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of all documents (columns) for some items (rows)."""
        holders: dict[int, list[int]] = {}
        for k, own in enumerate(terms):
            for t in own.tolist():
                holders.setdefault(t, []).append(k)
        upper = np.zeros((len(terms), len(self.doc_ids)), np.int64)
        lower = upper.copy()
        for t in holders.keys() & self.places.keys():
            at = self.places[t]
            cells = np.ix_(holders[t], self.docs[at])
            upper[cells] += weights[t] * self.bytes[at]
            lower[cells] += weights[t] * np.maximum(self.bytes[at] - 1, 0)
        return upper * _STEP, lower * _STEP

    def exact(self, terms: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The scores of those documents that are wanted (a mask), 0 for others."""
        scores = np.zeros(len(self.doc_ids), np.int64)
        for t in terms.tolist():
            if (at := self.places.get(t)) is not None:
                mine = wanted[self.docs[at]]
                docs, tf = self.docs[at][mine], self.tf[at][mine]
                scores[docs] += weights[t] * _quantised(tf, self.m[docs])[0]
        return scores


_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _searching(asked: Broadcast, k: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Asked = asked.value
        best = [_NOTHING] * len(block.items)
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                step = max(1, cells // len(chunk.doc_ids))
                for low in range(0, len(block.items), step):
                    terms = block.terms[low : low + step]
                    upper, lower = chunk.bounds(terms, block.weights)
                    sure = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.zeros(len(terms), np.int64)
                    for own, own_terms in enumerate(terms):
                        scores, ids = best[low + own]
                        reach = max(1, int(sure[own]), int(scores[-1]) if len(scores) == k else 0)
                        wanted = upper[own] >= reach
                        if wanted.any():
                            found = chunk.exact(own_terms, block.weights, wanted)
                            some = found > 0
                            best[low + own] = _best(np.concatenate([scores, found[some]]), np.concatenate([ids, chunk.doc_ids[some]]), k)
        sizes = [len(scores) for scores, _ in best]
        columns = [np.repeat(np.array(block.items, np.int64), sizes), *(np.concatenate([np.zeros(0, np.int64), *(b[x] for b in best)]) for x in (1, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "doc_id", "score"])

    return run


def weight(n_docs: int, df: int) -> int:
    """How much a term counts that df of n_docs documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _index(docs: DataFrame, vocabulary: list[bytes], chunk_docs: int) -> tuple[DataFrame | None, np.ndarray]:
    """The index of documents over a vocabulary, and the weights of its terms; none if no document has words."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(pa.array(vocabulary, pa.large_binary()))
    counted = materialise(docs.mapInArrow(_counting(known), "doc_id long, n long, terms array<int>, tfs array<int>"), "counted")
    n_docs, n_words = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None, np.zeros(0, np.int64)
    held = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most a row for each term of the block
        held[r["term"]] = r["count"]
    rows = counted.where("doc_id is not null and size(terms) > 0")
    index = materialise(rows.mapInArrow(_indexing(n_docs, n_words, chunk_docs), _CHUNK), "index")
    return index, np.array([weight(n_docs, df) for df in held.tolist()], np.int64)


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, chunk_docs: int = 4096, block_terms: int = 500_000, cells: int = 1 << 20) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank (from 1), doc_id, score.

    Only scores above 0 count; equal ones go by doc_id. Items without words or matches
    have no rows, a null text has no words. Each row of items is an item of its own,
    also where item_ids repeat or are null, and each row of docs a document; those
    without a doc_id count in the statistics but are not ranked. Without documents or
    items there are no rows. Columns other than doc_id, item_id and text are not read.
    block_terms bounds the terms of the items that are sent to all tasks at once, besides
    a single longer item; chunk_docs and cells bound what a task holds.
    """
    spark = session(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text")
    asked = materialise(rows.mapInArrow(_item_terms, "item long, item_id long, terms array<binary>").where("size(terms) > 0"), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    parts = spark.createDataFrame([], "item long, doc_id long, score long")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms").collect()  # about block_terms terms
        vocabulary = sorted({bytes(t) for r in block for t in r["terms"]})
        index, weights = _index(docs, vocabulary, chunk_docs) if block else (None, None)
        if index is None:
            continue
        place = {t: n for n, t in enumerate(vocabulary)}
        sent = spark.sparkContext.broadcast(Asked([r["item"] for r in block], [np.array(sorted(place[bytes(t)] for t in r["terms"]), np.int64) for r in block], weights))
        parts = parts.unionByName(index.mapInArrow(_searching(sent, k, cells), "item long, doc_id long, score long"))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
