"""Exact duplicates by skew-safe combining: locally, by salted digest, then globally, with whole texts compared at each step.

1. Locally: a task cuts its rows into blocks of bounded size and keeps one row of each
   text in a block, with the ids of all that have it. This is where most rows of a
   text that is everywhere vanish.
2. By salted digest: of the digests that more than one block holds, the rows go by
   (digest, salt, text) to as many salts as the square root of the blocks that hold it,
   so no task gets all blocks of a text, and each text of a salt keeps one row.
3. Globally: the winners of the salts meet by (digest, text).

A digest only says which texts can be equal. A block compares the bytes themselves, and
the other steps group by the text beside its digest, so texts whose digests collide stay
apart. Texts of digests that one block alone holds never move. What is decided goes back
over the numbers of block rows, of which there is one each, so no join has a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumframe.llm.common import materialise, session


def digest_of(text: bytes) -> bytes:
    return sha256(text).digest()


def _block(rows: pa.Table, digest: Callable[[bytes], bytes], largest: bool) -> pa.RecordBatch:
    """One row for each text of a block: that of the winner, with all ids and the place of the winner among them."""
    texts = pc.fill_null(rows["text"].cast(pa.large_binary()), b"").to_pylist()
    ids = rows["id"].to_pylist()
    seen: dict[bytes, list[int]] = {}
    members: list[list[int]] = []
    winners: list[int] = []
    digests: list[bytes] = []
    for k, text in enumerate(texts):
        own = digest(text)
        alike = seen.setdefault(own, [])
        group = next((g for g in alike if texts[members[g][0]] == text), None)
        if group is None:
            alike.append(len(members))
            members.append([k])
            winners.append(k)
            digests.append(own)
            continue
        members[group].append(k)
        best = ids[winners[group]]
        if ids[k] is not None and (best is None or (ids[k] > best if largest else ids[k] < best)):
            winners[group] = k
    own = rows["own"].combine_chunks().take(pa.array(winners, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            own,
            pa.array([texts[w] for w in winners], pa.large_binary()).cast(pa.string()),
            pa.array(digests, pa.binary()),
            pa.array([[ids[k] for k in m] for m in members], pa.list_(pa.int64())),
            pa.array([m.index(w) for m, w in zip(members, winners)], pa.int32()),
        ],
        ["own", "text", "digest", "ids", "at"],
    )


def _combining(block_bytes: int, digest: Callable[[bytes], bytes], largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                yield _block(pa.Table.from_batches(held), digest, largest)
                held, size = [], 0
        if held:
            yield _block(pa.Table.from_batches(held), digest, largest)

    return run


def _order(id_: Column, largest: bool) -> Column:
    """Larger for rows that rather stay; rows without an id come last."""
    return F.struct(id_.isNotNull().alias("known"), (id_ if largest else F.bitwise_not(id_)).alias("by"))


def _decided(rows: DataFrame, own: Column, block_bytes: int, digest: Callable[[bytes], bytes], largest: bool) -> DataFrame:
    """One row for each text of each block: own, digest, ids, at, and won (its winner is that of the whole table), keep_id, group_size."""
    shown = rows.select(own.alias("own"), F.col("doc_id").cast("long").alias("id"), "text")
    schema = shown.select("own", "text", F.lit(b"").alias("digest"), F.array("id").alias("ids"), F.lit(0).alias("at")).schema
    blocks = materialise(shown.mapInArrow(_combining(block_bytes, digest, largest), schema).withColumn("block", F.monotonically_increasing_id()), "blocks")
    id_ = F.col("ids")[F.col("at")]
    shared = blocks.groupBy("digest").agg(F.count("*").alias("held")).where("held > 1")
    met = blocks.select("digest", "text", "block", F.size("ids").cast("long").alias("n"), F.struct(_order(id_, largest).alias("order"), "block", id_.alias("id")).alias("best")).join(shared, "digest")
    salted = met.withColumn("salt", F.pmod(F.xxhash64("block"), F.ceil(F.sqrt("held")))).groupBy("digest", "salt", "text").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
    whole = salted.groupBy("digest", "text").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.flatten(F.collect_list("blocks")).alias("blocks"))
    placed = whole.select("best", "n", F.explode("blocks").alias("block"))
    found = blocks.drop("text").join(placed, "block", "left")
    alone = F.col("best").isNull()
    return found.select(
        "own", "digest", "ids", "at",
        (alone | (F.col("best.block") == F.col("block"))).alias("won"),
        F.when(alone, id_).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.size("ids").cast("long")).alias("group_size"),
    )


def exact_duplicates(docs: DataFrame, *, largest: bool = True, block_bytes: int = 32 << 20) -> DataFrame:
    """Which documents have equal texts, and which row of each group stays.

    One row per row of docs: doc_id, keep_id (doc_id of the row that stays), group_size,
    kept and text_sha256. A null text counts as empty. Of equal texts the row with the
    largest doc_id stays (the smallest, with largest=False); of several rows with that
    doc_id exactly one. Rows without a doc_id stay only where no row of the group has one.
    An empty table gives no rows; columns other than doc_id and text are not read.
    block_bytes bounds what a task holds at once, besides a single longer text.
    """
    session(docs.sparkSession)
    found = _decided(docs, F.lit(None).cast("int"), block_bytes, digest_of, largest)
    each = found.select("keep_id", "group_size", "won", "at", F.lower(F.hex("digest")).alias("text_sha256"), F.posexplode("ids").alias("place", "doc_id"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("won") & (F.col("place") == F.col("at"))).alias("kept"), "text_sha256")


def unlike_texts(docs: DataFrame, *, largest: bool = True, block_bytes: int = 32 << 20, digest: Callable[[bytes], bytes] = digest_of) -> DataFrame:
    """One row of docs for each text, all columns as they are; see exact_duplicates for which.

    digest says which texts can be equal; those that it confuses are told apart.
    """
    session(docs.sparkSession)
    return _decided(docs, F.struct(*docs.columns), block_bytes, digest, largest).where("won").select("own.*")
