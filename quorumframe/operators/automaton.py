"""Very many labels in very many texts.

Labels that fit a task go there as one automaton, which passes once over each text. More
labels than that leave a mark each in a filter of a fixed size; runs of words of a text
that are as long as a label and bear a mark, hits and a few others, meet the labels in a
join. Either way the texts are read once, whatever the number of labels, and no other run
of words leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumframe.functions.text import folded

#: The automaton that a Python worker has built last, by the number of its broadcast.
_BUILT: dict[int, ahocorasick.Automaton] = {}


def folded_words(c: Column | str) -> Column:
    return F.regexp_extract_all(folded(c), F.lit("[a-z0-9]+"), F.lit(0))


def _automaton(shard: Broadcast) -> ahocorasick.Automaton:
    """Built once in a worker. A word begins and ends at a blank, and two labels may share the one between them."""
    number = shard._jbroadcast.id() if shard._jbroadcast is not None else shard._path  # type: ignore[attr-defined]
    if number not in _BUILT:
        made = ahocorasick.Automaton()
        for k, label in enumerate(shard.value):
            made.add_word(f" {label} ", k)
        made.make_automaton()
        _BUILT.clear()
        _BUILT[number] = made
    return _BUILT[number]


def _finding(shard: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _automaton(shard).iter
        for batch in batches:
            held = [sorted({k for _, k in find(f" {text} ")}) if text else [] for text in batch["said"].to_pylist()]
            rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
            labels = pa.array([shard.value[k] for h in held for k in h], pa.string())
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(rows)), labels], [batch.schema.names[0], "label"])

    return run


def _hashes(words: list[str], size: int, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter of each run of size words."""
    each = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    own = np.fromiter((each[w] for w in words), np.uint64, len(words))
    runs = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(runs)]
        runs ^= runs >> np.uint64(31)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    return (runs >> np.uint64(64 - log_bits)).astype(np.int64), (runs & np.uint64((1 << log_bits) - 1)).astype(np.int64)


def _marking(log_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: list[int] = []
            for label in batch[0].to_pylist():
                words = label.split(" ")
                places += [int(h[0]) for h in _hashes(words, len(words), log_bits)]
            found = np.unique(np.array(places, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found >> 6), pa.array(np.int64(1) << (found & 63))], ["cell", "bits"])

    return run


def _meeting(marks: Broadcast, sizes: list[int], log_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        marked = lambda places: bits[places >> 6] >> (places & 63) & 1
        for batch in batches:
            rows, labels = [], []
            table = lambda: pa.RecordBatch.from_arrays([batch[0].take(pa.array(rows, pa.int64())), pa.array(labels, pa.string())], [batch.schema.names[0], "label"])  # noqa: B023, E731
            for row, text in enumerate(batch["said"]):
                words = (text.as_py() or "").split()
                held = set()
                for size in sizes:
                    one, other = _hashes(words, size, log_bits)
                    held.update(" ".join(words[k : k + size]) for k in np.flatnonzero(marked(one) & marked(other)).tolist())
                rows += [row] * len(held)
                labels += sorted(held)
                if len(rows) >= 10_000:
                    yield table()
                    rows, labels = [], []
            yield table()

    return run


def _runs_with_marks(said: DataFrame, labels: DataFrame, schema: str, log_bits: int) -> DataFrame:
    """Runs of words of the texts that may be labels; every one that is a label is among them."""
    spark = said.sparkSession
    sizes = sorted(r["n"] for r in labels.select(F.size(F.split("label", " ")).alias("n")).distinct().collect())
    marks = np.zeros(1 << log_bits - 6, np.int64)
    cells = labels.mapInArrow(_marking(log_bits), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()  # as many as the filter has, at most
    marks[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return said.mapInArrow(_meeting(spark.sparkContext.broadcast(marks), sizes, log_bits), schema)


def labels_in(texts: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, *, shard_letters: int = 1_000_000, log_bits: int = 27) -> DataFrame:
    """key, label_key, label of each label whose words stand in the text in order, as whole words; folded on both sides.

    Labels of the same words are found alike, each with its own label_key; a label
    without words is never found, a null text holds none. A text gives a label once,
    rows of texts that share a key each their own. Labels of more than shard_letters in all
    are found by a filter of 2**log_bits bits (16 MB) and a join.
    """
    spark = texts.sparkSession
    wanted = labels.select(label_key, F.array_join(folded_words(label), " ").alias("label")).where("label <> ''")
    distinct = wanted.select("label").distinct()
    letters = distinct.agg(F.sum(F.length("label"))).first()[0] or 0
    said = texts.select(key, F.array_join(folded_words(text), " ").alias("said"))
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, label string"
    if letters > shard_letters:
        found = _runs_with_marks(said, distinct, schema, log_bits)
    else:
        own = [r["label"] for r in distinct.collect()]  # at most shard_letters letters
        found = said.mapInArrow(_finding(spark.sparkContext.broadcast(sorted(own))), schema) if own else spark.createDataFrame([], schema)
    return found.join(wanted, "label").select(key, label_key, "label")
