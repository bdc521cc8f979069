"""Benchmark decontamination by a prefix-filtered set join.

An item of the benchmark is cut into windows of consecutive words. A window is
contained in a document where its words stand there in order. As containment has to
be complete, the necessary prefix of a window is its single rarest shingle: a document
without that shingle cannot hold the window. So

1. shingles of all windows are ordered by their document frequency in the corpus,
   counted in one pass over whole texts, which a Bloom filter of the benchmark's
   shingles thins;
2. each window is indexed by its rarest shingle alone;
3. a second pass, thinned by a Bloom filter of those, gives for each of them its place
   in a document and the words around it, and meets the index in a join; the place of
   the shingle in the window and the words there are on either side bound where the
   window would start and end (positional and length bound), and only then are the
   words compared.

Both passes are there once, whatever the size of the benchmark. Nothing of it is
broadcast but two filters of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.llm.common import materialise

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


_TABLE = np.frombuffer(_WORD_BYTES, np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd number with mixed bits
_LONG = 64  # words of more bytes are hashed one by one
_SLICE_BYTES = 2 << 20


class Words:
    """The words of several UTF-8 texts, as arrays: letters and digits of ASCII, A-Z lower-cased, and everything beyond ASCII.

    text, starts, ends and hashes have an entry for each word; first is where the
    words of each text begin, and one more entry where all end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = np.concatenate([_TABLE[data], np.full(8, 32, np.uint8)])
        inside = self.data != 32
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        begun = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text ends the word before it
        opens[begun] = inside[begun]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | opens[1:]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hashes = self._hashed()

    def _hashed(self) -> np.ndarray:
        """Eight bytes at a time are mixed in, for all words at once."""
        blocks = np.ndarray(max(0, len(self.data) - 7), "<u8", self.data, strides=(1,))
        sizes = self.ends - self.starts
        out, open_ = np.full(len(sizes), 1, np.uint64), np.flatnonzero(sizes <= _LONG)
        for at in range(0, _LONG, 8):
            left = np.minimum(sizes[open_] - at, 8).astype(np.uint64)
            block = blocks[self.starts[open_] + at] & np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
            mixed = (out[open_] ^ block) * _MIX
            out[open_] = mixed ^ mixed >> np.uint64(29)
            open_ = open_[sizes[open_] > at + 8]
            if not len(open_):
                break
        for k in np.flatnonzero(sizes > _LONG).tolist():
            out[k] = xxhash.xxh64_intdigest(self.data[self.starts[k] : self.ends[k]].tobytes())
        return out

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each shingle of so many words of one text, and the word it begins with; other sizes have other hashes."""
        at = np.flatnonzero(self.text[: max(0, len(self.text) - size + 1)] == self.text[size - 1 :])
        total = np.full(len(at), size, np.uint64)
        for k in range(size):
            total = (total ^ self.hashes[at + k]) * _MIX
            total ^= total >> np.uint64(29)
        return total, at

    def said(self, low: int, high: int) -> str:
        """Words from low to before high, a space between each two; all of one text."""
        return b" ".join(self.data[self.starts[low] : self.ends[high - 1]].tobytes().split()).decode()


def cut(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """The words of a column of texts, in slices of a bounded size or of one text, each with the number of the text it begins with."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _SLICE_BYTES, "right")) - 1)
        yield low, Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    """Three places of each value in a filter of so many bits (a power of two), a row each."""
    mask = np.uint64(bits - 1)
    return np.stack([(values >> np.uint64(s)) & mask if s else values & mask for s in (0, 17, 34)])


class Bloom:
    """A filter of hashes that is never wrong about what it lacks."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.bits = words, len(words) * 64

    @classmethod
    def of(cls, spark: SparkSession, values: DataFrame, count: int, most_bytes: int) -> Bloom:
        """The filter of a table's column shingle, some 16 bits a value, up to most_bytes; the executors set its bits."""
        bits = 64
        while bits < 16 * count and bits < 8 * most_bytes:
            bits *= 2
        places = values.select(F.explode(F.array(*(F.shiftrightunsigned("shingle", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 17, 34)))).alias("place"))
        set_ = places.groupBy((F.col("place") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("set")).collect()
        words = np.zeros(bits // 64, np.uint64)
        for row in set_:
            words[row["word"]] = np.int64(row["set"]).view(np.uint64)
        return cls(words)

    def holds(self, values: np.ndarray) -> np.ndarray:
        at = np.arange(len(values))
        for k in range(3):  # each place is looked at only where those before are set
            places = _places(values[at], self.bits)[k]
            at = at[(self.words[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)]
        held = np.zeros(len(values), bool)
        held[at] = True
        return held


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, ids, texts = batch["item_id"].to_pylist(), [], []
            for low, words in cut(batch["text"]):
                for k, (begun, ended) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    for text in {words.said(at, min(at + window, ended)) for at in range(begun, max(begun, ended - window) + 1)} if ended > begun else ():
                        ids.append(owners[low + k])
                        texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["item_id", "window"])

    return run


def _cut(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, values = [], []
            for _, words in cut(batch["window"]):
                every = {n: words.shingles(n) for n in range(1, shingle + 1)}
                for begun, ended in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    sizes.append(min(shingle, ended - begun))
                    hashed, at = every[sizes[-1]]
                    values.append(hashed[np.searchsorted(at, begun) : np.searchsorted(at, ended)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["window"], pa.array(sizes, pa.int32()), pa.array(values, pa.list_(pa.int64()))], ["window", "size", "shingles"])

    return run


def _frequencies(bloom, sizes: tuple[int, ...]):
    """How many documents of a slice hold each shingle that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in cut(batch["text"]):
                for size in sizes:
                    values, at = words.shingles(size)
                    held = bloom.value.holds(values)
                    pairs = np.unique(np.stack([values[held], words.text[at[held]].astype(np.uint64)]), axis=1)
                    values, counts = np.unique(pairs[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["shingle", "df"])

    return run


_PLACE = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("around", pa.string())])
_MET = "array<struct<shingle:long,at:int,first:int,around:string>>"


def _met(words: Words, bloom: Bloom | None, sizes: tuple[int, ...], window: int) -> tuple[np.ndarray, list[dict]]:
    """Shingles that the filter lets through, by text: where each stands, and the words that a window with it can reach, from the word first on."""
    found = []
    for size in sizes if bloom else ():
        values, at = words.shingles(size)
        held = bloom.holds(values)
        found += zip(at[held].tolist(), values[held].view(np.int64).tolist())
    found.sort()
    owners = words.text[[at for at, _ in found]] if found else np.zeros(0, np.int64)
    begun, ended, out = words.first[:-1].tolist(), words.first[1:].tolist(), []
    for (at, value), k in zip(found, owners.tolist()):
        low = max(begun[k], at - window + 1)
        out.append({"shingle": value, "at": at - begun[k], "first": low - begun[k], "around": words.said(low, min(ended[k], at + window))})
    return np.bincount(owners, minlength=len(begun)), out


def _meeting(bloom, sizes: tuple[int, ...], window: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, numbers, places = [], [], []
            for _, words in cut(batch["text"]):
                counts.append(np.diff(words.first))
                of_text, found = _met(words, bloom.value, sizes, window)
                numbers.append(of_text)
                places += found
            none = [np.zeros(0, np.int64)]
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(numbers or none))])
            met = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, _PLACE))
            own = batch.columns if keep else [batch["doc_id"]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(counts or none), pa.int64()), met], [*(batch.schema.names if keep else ["doc_id"]), "_n_words", "_met"])

    return run


def _indexed(docs: DataFrame, items: DataFrame, window: int, shingle: int, filter_bytes: int) -> tuple[DataFrame | None, DataFrame | None, tuple[int, ...], object]:
    """Windows by their rarest shingle, the items that own them, the sizes of shingles there are, and the filter of the rarest."""
    spark = docs.sparkSession
    owned = materialise(items.select(F.col("item_id").cast("long"), "text").mapInArrow(_windows(window), "item_id long, window string").distinct(), "windows")
    cut = materialise(owned.select("window").distinct().mapInArrow(_cut(shingle), "window string, size int, shingles array<long>"), "cut")
    each = cut.select("window", "size", F.posexplode("shingles").alias("offset", "shingle"))
    wanted = each.select("shingle").distinct()
    sizes = tuple(sorted(r["size"] for r in cut.select("size").distinct().collect()))
    if not sizes:
        return None, None, (), spark.sparkContext.broadcast(None)
    bloom = spark.sparkContext.broadcast(Bloom.of(spark, wanted, wanted.count(), filter_bytes))
    counted = docs.select("text").mapInArrow(_frequencies(bloom, sizes), "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df"))
    rarest = each.join(counted, "shingle", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("r"))
    index = materialise(rarest.where("r.df > 0").select("window", F.col("r.shingle").alias("shingle"), F.col("r.offset").alias("offset")), "index")
    few = index.select("shingle").distinct()
    return owned, index, sizes, spark.sparkContext.broadcast(Bloom.of(spark, few, few.count(), filter_bytes))


#: Parts that the windows of a shingle are copied to, so that one that very many documents hold meets them in as many tasks.
_SALTS = 16


def _hits(marked: DataFrame, index: DataFrame) -> DataFrame:
    """_row, window, start and end (in words) of each occurrence, from the places where shingles of the index stand."""
    met = marked.where(F.size("_met") > 0).select("_row", F.explode("_met").alias("m"))
    met = met.select("_row", "m.*", F.pmod(F.xxhash64("_row", "m.at"), F.lit(_SALTS)).cast("int").alias("salt"))
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    start = F.col("at") - F.col("offset")
    words = F.split("around", " ")
    size = F.size(F.split("window", " "))
    fits = (start >= F.col("first")) & (start - F.col("first") + size <= F.size(words))
    there = F.array_join(F.slice(words, F.greatest(start - F.col("first") + 1, F.lit(1)), size), " ")
    return met.join(copies, ["shingle", "salt"]).where(fits & (there == F.col("window"))).select("_row", "window", start.alias("start"), (start + size).alias("end")).distinct()


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (start, end), which are sorted: each counts from where those before it end."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto")),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, shingle: int = 2, filter_bytes: int = 16 << 20) -> DataFrame:
    """How much of each document stands in a benchmark item.

    One row per row of docs: doc_id, n_words, n_hit (words inside any occurrence
    of a window), n_items (items with such a window), items_sha256 and
    contaminated. A null or empty text has no words and no hits. Repeated rows of
    docs give repeated rows. Items with equal texts all count; those without an id are
    one item, whose words are hit and which the digest does not name. An item without
    words has no window; with no items nothing is contaminated. Null doc_ids stay
    null. Columns other than doc_id, item_id and text are not read. filter_bytes
    bounds what is broadcast; a benchmark too large for it only lets more places
    through to the join.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    owned, index, sizes, bloom = _indexed(docs, items, window, shingle, filter_bytes)
    marked = docs.mapInArrow(_meeting(bloom, sizes, window, False), f"doc_id long, _n_words long, _met {_MET}")
    marked = materialise(marked.withColumn("_row", F.monotonically_increasing_id()), "met")
    plain = marked.select("doc_id", F.col("_n_words").alias("n_words"), "_row")
    if index is None:
        return plain.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    hits = materialise(_hits(marked, index), "hits")
    spans = hits.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    held = hits.select("_row", "window").distinct().join(owned, "window").select("_row", "item_id").distinct()
    named = held.groupBy("_row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    found = plain.join(spans.select("_row", _covered(F.col("spans")).alias("n_hit")), "_row", "left").join(named, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", zero("n_hit").alias("n_hit"), zero("n_items").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, *, window: int = 10, shingle: int = 2, filter_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs in which no window of an item occurs, all columns as they are; see contamination.

    Documents in which the filter finds nothing go straight through; only the others are shuffled.
    """
    _, index, sizes, bloom = _indexed(docs, items, window, shingle, filter_bytes)
    if index is None:
        return docs
    schema = docs.select("*", F.lit(None).cast("long").alias("_n_words"), F.lit(None).cast(_MET).alias("_met")).schema
    marked = materialise(docs.mapInArrow(_meeting(bloom, sizes, window, True), schema).withColumn("_row", F.monotonically_increasing_id()), "met")
    clear = marked.where(F.size("_met") == 0)
    suspects = marked.where(F.size("_met") > 0)
    hit = _hits(marked, index).select("_row").distinct()
    return clear.select(docs.columns).unionByName(suspects.join(hit, "_row", "left_anti").select(docs.columns))
