"""Token ids in files of length-delimited records, with an offset index apart.

A record is: length of the payload (8 bytes), masked checksum of those bytes (4),
payload, masked checksum of the payload (4), all little-endian. The payload is the
doc_id (8 bytes), the width of an id in bytes (1, with the highest bit set where the
document has no doc_id), and the ids. A masked checksum
is the CRC-32 rotated right by 15 bits plus a constant, so that checksums of data
that hold checksums stay sound. The index has a row for each record: file, offset
and length; any order or subset of it can be read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.llm.common import materialise, new_path
from quorumframe.llm.tokens import grouped, tokenizer

_MASK_ADDED = 0xA282EAD8
_HEAD, _TAIL, _ID = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qB")
_NO_ID = 0x80
_READ_BYTES = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_ADDED) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = (_ID.pack(0, width | _NO_ID) if doc_id is None else _ID.pack(doc_id, width)) + ids
    length = struct.pack("<Q", len(payload))
    return length + _TAIL.pack(masked(length)) + payload + _TAIL.pack(masked(payload))


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id (None if it has none) and ids of one whole record; raises ValueError if it is damaged."""
    length, check = _HEAD.unpack_from(record)
    payload = record[_HEAD.size : _HEAD.size + length]
    if masked(record[:8]) != check or len(record) != _HEAD.size + length + _TAIL.size or _TAIL.unpack_from(record, _HEAD.size + length)[0] != masked(payload):
        raise ValueError("damaged record")
    doc_id, width = _ID.unpack_from(payload)
    return None if width & _NO_ID else doc_id, np.frombuffer(payload, f"<u{width & ~_NO_ID}", offset=_ID.size)


_INDEX = "part int, file string, offset long, length int, doc_id long, before long, n_tokens long"
_INDEX_ARROW = pa.schema([("part", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64())])


def _writing(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        part = TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        name, offset, before, out = f"part-{part:05d}-{uuid.uuid4().hex}.records", 0, 0, None
        for batch in batches:
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}")
            rows, ids = [], iter(batch["doc_id"].to_pylist())
            for texts in grouped(batch["text"].to_pylist()):
                for doc_id, encoded in zip((next(ids) for _ in texts), encoder.encode(texts)):
                    record = frame(doc_id, encoded + end, width)
                    out.write(record)
                    n = len(encoded) // width + 1
                    rows.append((part, name, offset, len(record), doc_id, before, n))
                    offset, before = offset + len(record), before + n
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 7, _INDEX_ARROW)], schema=_INDEX_ARROW)
        if out is not None:
            out.close()

    return run


def write_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, end_id: int = 1) -> tuple[str, DataFrame]:
    """Encode whole texts and write them in ascending doc_id order; the folder and the index.

    Files follow one another by part, records within by offset. A null text is
    empty: its record holds end_id alone. Documents of one doc_id follow one another
    in the order of their texts' hashes; those without a doc_id come after all others,
    so no other document's place depends on them. The file names are new in every attempt, and the index names those that count.
    """
    folder = folder or new_path(docs.sparkSession, "records")
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), "tie"]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    return folder, materialise(ordered.mapInArrow(_writing(folder, tokenizer_path, end_id), _INDEX), "offsets")


def _reading(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = list(zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist()))
            ids, counts, sums = [], [], []
            for name, of_file in groupby(rows, key=lambda r: r[0]):
                with system.open_input_file(f"{root}/{name}") as source:
                    for data in _stretches(source, list(of_file)):
                        doc_id, tokens = unframe(data)
                        ids.append(doc_id)
                        counts.append(len(tokens))
                        sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch["part"], batch["before"], pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    return run


def _stretches(source, rows: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """Records in the order of rows; neighbours in the file are read together."""
    at = 0
    while at < len(rows):
        upto, start = at + 1, rows[at][1]
        end = start + rows[at][2]
        while upto < len(rows) and rows[upto][1] == end and end - start < _READ_BYTES:
            end += rows[upto][2]
            upto += 1
        data = source.read_at(end - start, start)
        for _, offset, length in rows[at:upto]:
            yield data[offset - start : offset - start + length]
        at = upto


def read_digests(folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record, from the files.

    start is the number of ids in all records before. Only one total for each file
    goes to the driver.
    """
    spark = index.sparkSession
    totals = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0)))
    parts = spark.createDataFrame(list(starts.items()) or [], "part int, base long")  # a row for each file
    read = index.mapInArrow(_reading(folder), "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
