"""SimHash near-duplicates, searched with vantage-point trees over the shards.

Equal fingerprints meet first, in one aggregation. Distinct fingerprints are then
dealt to the leaves of a few vantage-point trees, one for each segment of their
bits: at a node, those within the radius of the vantage point go left, the others
right. Two fingerprints that differ in at most r bits differ in at most
r // segments bits of some segment. By the triangle inequality a partner lies on
the far side of a node of that segment's tree only if x is within this margin of
the boundary, and x visits those leaves as well. By default there are two segments
of 32 bits and the margin is one bit.

The trees are fitted on a bounded sample. A leaf that is home to too many points is cut
again, in rounds that all such leaves take together: a vantage point and a radius for
each by aggregation, then home and visiting points go to its two sides by the same
rule. So no leaf exceeds its bound, however many points there are. Points that share a
whole segment are cut by all 64 bits, with the full margin.

Inside a leaf the same rule, over all bits and with the full margin r, is applied
again to ever smaller groups until they are small enough to compare in full. Only
a spanning forest of the links leaves a leaf, so a large group of near copies
yields as many edges as it has members, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumframe.llm.common import hot_join, materialise
from quorumframe.operators.components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles; zero for a text without words."""
    words = raw.translate(_LOWER).split() if raw else []
    if not words:
        return 0
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    total, counts = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        upto = min(total, at + _CHUNK)
        values = np.array([hashed(text[s:e], 42) for s, e in zip(starts[at:upto].tolist(), ends[at + size - 1 : upto + size - 1].tolist())], ">u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _marking(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch["text"].cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([_signed(fingerprint(r, shingle)) for r in raws], pa.int64()), batch["text_hash"]], ["doc_id", "fp", "text_hash"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and text_hash, one row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_marking(shingle), "doc_id long, fp long, text_hash long")


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that halves the points best; None if nothing does."""
    vantage = points[len(points) // 2]
    distances = _distance(points, vantage)
    radius = int(np.median(distances))
    if not (distances <= radius).any() or (distances <= radius).all():
        radius -= 1
    return (vantage, radius) if 0 < (distances <= radius).sum() < len(points) else None


def vantage_tree(sample: np.ndarray, depth: int) -> tuple | None:
    """Nested (vantage, radius, inside, outside); None is a leaf."""
    if depth == 0 or len(sample) < 8 or (cut := _split(sample)) is None:
        return None
    vantage, radius = cut
    near = _distance(sample, vantage) <= radius
    return int(vantage), radius, vantage_tree(sample[near], depth - 1), vantage_tree(sample[~near], depth - 1)


def _deal(tree: tuple | None, points: np.ndarray, reach: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The home leaf of each point, and (leaf, indexes of the points that visit it from a leaf before)."""
    homes, visits = np.zeros(len(points), np.int32), []
    leaves = 0

    def walk(node: tuple | None, own: np.ndarray, guests: np.ndarray) -> None:
        nonlocal leaves
        if node is None:
            homes[own] = leaves
            visits.append((leaves, guests))
            leaves += 1
            return
        vantage, radius, inside, outside = node
        d_own, d_guest = _distance(points[own], np.uint64(vantage)), _distance(points[guests], np.uint64(vantage))
        walk(inside, own[d_own <= radius], guests[d_guest <= radius + reach])
        # a pair is met once: only those that live further left visit to the right
        crossing = own[(d_own <= radius) & (d_own > radius - reach)]
        walk(outside, own[d_own > radius], np.concatenate([guests[d_guest > radius - reach], crossing]))

    walk(tree, np.arange(len(points)), np.zeros(0, np.int64))
    return homes, visits


def _segment(points: np.ndarray, k: int, segments: int) -> np.ndarray:
    """Bits of segment k, the others zero."""
    low, high = 64 * k // segments, 64 * (k + 1) // segments
    return points & np.uint64((1 << high) - (1 << low))


def _shards(trees, margin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch["fp"].to_numpy().view(np.uint64)
            for k, tree in enumerate(trees.value):
                homes, visits = _deal(tree, _segment(points, k, len(trees.value)), margin)
                leaf = np.concatenate([homes, *(np.full(len(g), at, np.int32) for at, g in visits)])
                fp = np.concatenate([points, *(points[g] for _, g in visits)])
                home = np.arange(len(leaf)) < len(points)
                columns = [pa.array(np.full(len(leaf), k, np.int32)), pa.array(leaf.astype(np.int64)), pa.array(fp.view(np.int64)), pa.array(home)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "fp", "home"])

    return run


class _Forest:
    """Union-find over indexes, joined by whole arrays of links at a time."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)

    def find(self, at: np.ndarray) -> np.ndarray:
        roots = self.root[at]
        while (above := self.root[roots]) is not None and (above != roots).any():
            roots = above
        self.root[at] = roots
        return roots

    def _one(self, at: int) -> int:
        while self.root[at] != at:
            self.root[at] = self.root[self.root[at]]
            at = int(self.root[at])
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.find(a), self.find(b)], axis=1), axis=0)
        for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            x, y = self._one(x), self._one(y)
            self.root[max(x, y)] = min(x, y)


def _link(forest: _Forest, points: np.ndarray, homes: np.ndarray, guests: np.ndarray, reach: int, small: int = 128) -> None:
    """Join all home-home and guest-home pairs within reach, by recursion over vantage points."""
    stack = [(homes, guests)]
    while stack:
        own, others = stack.pop()
        if not len(own):
            continue
        cut = _split(points[own]) if len(own) > small else None
        if cut is None:
            asking = np.concatenate([own, others])
            step = max(1, 2_000_000 // max(1, len(own)))
            for at in range(0, len(asking), step):
                part = asking[at : at + step]
                a, b = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[own][None, :]) <= reach)
                if len(a) > len(part[at : len(own)]):
                    forest.join(part[a], own[b])
            continue
        vantage, radius = cut
        d_own, d_other = _distance(points[own], vantage), _distance(points[others], vantage)
        near = d_own <= radius
        stack.append((own[near], others[d_other <= radius + reach]))
        stack.append((own[~near], np.concatenate([others[d_other > radius - reach], own[near & (d_own > radius - reach)]])))


def _edges(reach: int):
    def run(table: pa.Table) -> pa.Table:
        points, home = table["fp"].to_numpy().view(np.uint64), table["home"].to_numpy()
        forest = _Forest(len(points))
        _link(forest, points, np.flatnonzero(home), np.flatnonzero(~home), reach)
        at = np.arange(len(points))
        roots = forest.find(at)
        linked = roots != at
        return pa.table({"u": points[linked].view(np.int64), "v": points[roots[linked]].view(np.int64)})

    return run


#: Leaves whose facts are broadcast; those of more are copied to so many parts that no leaf gathers in one task.
_FEW_LEAVES, _SALTS = 50_000, 16


def _told(points: DataFrame, leaves: DataFrame) -> DataFrame:
    """points with what is said of their leaf; null where nothing is."""
    if leaves.count() <= _FEW_LEAVES:
        return points.join(F.broadcast(leaves), ["tree", "leaf"], "left")
    copies = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return points.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(_SALTS)).cast("int")).join(copies, ["tree", "leaf", "salt"], "left").drop("salt")


def split_leaves(dealt: DataFrame, *, reach: int, segments: int, most: int) -> DataFrame:
    """dealt (tree, leaf, fp, home), its leaves cut until none is home to more than most points.

    The vantage point of a leaf is the home point with the least hash, the radius that
    of the distances that halves the home points best. As a vantage point lies at
    distance zero and no other point does over all bits, each cut there leaves both
    sides smaller.
    """
    masks = F.array(*(F.lit(_signed((1 << 64 * (k + 1) // segments) - (1 << 64 * k // segments))) for k in range(segments)))
    mask = F.when(F.col("wide"), F.lit(-1).cast("long")).otherwise(masks[F.col("tree")])
    margin = F.when(F.col("wide"), F.lit(reach)).otherwise(F.lit(reach // segments))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")).bitwiseAND(mask))
    rest, done, depth = dealt.withColumn("wide", F.lit(False)), [], 0
    while True:
        home = F.when(F.col("home"), F.xxhash64("fp", F.lit(depth)))
        leaves = rest.groupBy("tree", "leaf").agg(F.count_if("home").alias("homes"), F.min_by("fp", home).alias("vantage"))
        large = materialise(leaves.where(F.col("homes") > most).drop("homes"), "large")
        if large.isEmpty():
            parts = [*done, rest.select("tree", "leaf", "fp", "home")]
            return parts[0] if len(parts) == 1 else _union(parts)
        told = materialise(_told(rest, large), "told")
        done.append(told.where("vantage is null").select("tree", "leaf", "fp", "home"))
        cut = told.where("vantage is not null").withColumn("d", distance)
        by_leaf = Window.partitionBy("tree", "leaf")
        counts = cut.groupBy("tree", "leaf", "d").agg(F.count_if("home").alias("n"))  # 65 rows a leaf at most
        counts = counts.withColumn("inside", F.sum("n").over(by_leaf.orderBy("d"))).withColumn("all", F.sum("n").over(by_leaf))
        radius = materialise(counts.where("inside < all").groupBy("tree", "leaf").agg(F.min_by("d", F.struct(F.abs(2 * F.col("inside") - F.col("all")), F.col("d"))).alias("radius")), "radius")
        met = _told(cut, radius)
        near, here, there = F.col("d") <= F.col("radius"), F.lit(True), F.lit(False)
        side = lambda when, right, own: F.when(when, F.struct(F.xxhash64("leaf", F.lit(right)).alias("leaf"), own.alias("home")))
        sides = F.array_compact(
            F.array(
                side(F.col("home") & near, 0, here),
                side(F.col("home") & ~near, 1, here),
                side(F.col("home") & near & (F.col("d") > F.col("radius") - margin), 1, there),  # a pair is met once: only those on the left visit the right
                side(~F.col("home") & (F.col("d") <= F.col("radius") + margin), 0, there),
                side(~F.col("home") & (F.col("d") > F.col("radius") - margin), 1, there),
            )
        )
        # a leaf whose points all share their segment is cut by all bits in the next round
        same = met.where("radius is null").select("tree", "leaf", "fp", "home", F.lit(True).alias("wide"))
        split = met.where("radius is not null").select("tree", F.explode(sides).alias("s"), "fp", "wide").select("tree", "s.leaf", "fp", "s.home", "wide")
        rest, depth = materialise(split.unionByName(same), "split"), depth + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _with_chunks(dealt: DataFrame, most: int) -> DataFrame:
    """dealt with chunk: the visitors of a leaf that has more than most go to several chunks, each with all home points."""
    crowded = dealt.groupBy("tree", "leaf").agg(F.count_if(~F.col("home")).alias("n")).where(F.col("n") > most)
    crowded = materialise(crowded.select("tree", "leaf", F.ceil(F.col("n") / most).cast("int").alias("chunks")), "crowded")
    if crowded.isEmpty():
        return dealt.withColumn("chunk", F.lit(0))
    every = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
    one = F.array(F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
    return _told(dealt, crowded).withColumn("chunk", F.explode(F.when(F.col("home"), every).otherwise(one))).drop("chunks")


def near_links(distinct: DataFrame, *, reach: int = 3, segments: int = 2, leaf_points: int = 3000, sample_points: int = 20_000) -> DataFrame:
    """Edges (u, v) of a forest that spans all links between distinct fingerprints fp.

    The trees are fitted on a bounded sample (sample_points, by hash order); every
    fingerprint is dealt and searched. No leaf is home to more than four times
    leaf_points, and no task sees more than four times as many visitors of it.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total) / leaf_points))))
    share = min(1.0, 2 * sample_points / max(1, total))
    drawn = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else distinct
    rows = drawn.orderBy(F.xxhash64("fp")).limit(sample_points).collect() if depth else []
    sample = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    segments = segments if depth else 1
    trees = [vantage_tree(_segment(sample, k, segments), depth) for k in range(segments)]
    sharded = distinct.mapInArrow(_shards(spark.sparkContext.broadcast(trees), reach // segments), "tree int, leaf long, fp long, home boolean")
    leaves = split_leaves(materialise(sharded, "dealt"), reach=reach, segments=segments, most=4 * leaf_points) if depth else sharded
    chunked = _with_chunks(leaves, 16 * leaf_points) if depth else leaves.withColumn("chunk", F.lit(0))
    return chunked.groupBy("tree", "leaf", "chunk").applyInArrow(_edges(reach), "u long, v long").distinct()


def _named(marked: DataFrame, reach: int) -> DataFrame:
    """fp, component (a fingerprint) and component_id of each distinct fingerprint of marked (doc_id, fp), and n, how many rows have it."""
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    linked = components(near_links(distinct.select("fp"), reach=reach))
    grouped = materialise(distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component")), "grouped")
    least = materialise(grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "least")
    return materialise(hot_join(grouped, least, "component", "members").select("fp", "component", "component_id", "n"), "named")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, reach: int = 3) -> DataFrame:
    """The component of near-duplicates of each document.

    One row per row of docs: doc_id, fingerprint (16 hex digits) and component_id,
    the smallest doc_id reachable over fingerprints that differ in at most reach
    bits. Null and empty texts have fingerprint zero and link like any other.
    Repeated rows give repeated rows. A null doc_id keeps its row; it is no
    component's smallest id unless the component has no other. Only doc_id and
    text are read; an empty table gives no rows. A fingerprint that a third of all
    rows share is met where its rows are, see hot_join.
    """
    marked = materialise(fingerprints(docs, shingle).drop("text_hash"), "fingerprints")
    named = _named(marked, reach).select("fp", "component_id", "n")
    return hot_join(marked, named, "fp", "n", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, shingle: int = 3, reach: int = 3) -> DataFrame:
    """The row with the smallest doc_id of each component, all columns as they are.

    Of rows that share this doc_id the one whose text hashes smallest stays; a
    component without any doc_id keeps one row likewise.
    """
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    return first_of_each(docs, marked, _named(marked, reach))


def first_of_each(docs: DataFrame, marked: DataFrame, named: DataFrame) -> DataFrame:
    """One row of docs for each component: marked has doc_id, fp and text_hash of each row, named the component of each fp."""
    # the least (doc_id, hash) of a fingerprint, then of a component: both are combined before the shuffle
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("least")
    first = marked.groupBy("fp").agg(least).join(named, "fp").groupBy("component").agg(F.min("least").alias("least"))
    kept = first.select(F.col("least.doc_id").alias("_id"), F.col("least.text_hash").alias("_hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    found = docs.join(kept.hint("shuffle_hash"), same, "left_semi")
    repeated = marked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    repeated = materialise(repeated, "repeated")
    if repeated.isEmpty():  # no id has a text twice, so found has no repeated rows
        return found
    others = [c for c in docs.columns if c != "doc_id"]
    once = found.join(repeated, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(*(F.any_value(c).alias(c) for c in others))
    return found.join(repeated, same, "left_anti").unionByName(once.select(docs.columns))
