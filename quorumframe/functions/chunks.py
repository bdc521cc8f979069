"""Splitting long texts into overlapping chunks, and putting chunks together again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk ends after the last of the first of these that stands in its second half.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def cut(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, chunk) of at most size characters; each but the first begins overlap characters before the end of the last."""
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            half = start + max(overlap + 1, size // 2)
            end = next((at + len(s) for s in SEPARATORS if (at := text.rfind(s, half, end)) >= 0), end)
        yield start, text[start:end]
        if end == len(text):
            return
        start = end - overlap


def joined(chunks: list[str], least: int = 20, most: int = 400) -> str:
    """Chunks end to end, without the longest beginning that repeats the end of what stands before."""
    out = chunks[0] if chunks else ""
    for chunk in chunks[1:]:
        common = next((k for k in range(min(most, len(out), len(chunk)), least, -1) if out.endswith(chunk[:k])), 0)
        out += chunk[common:]
    return out


def _cutting(key: str, size: int, overlap: int, most_chars: int = 1 << 20):
    """Chunks leave whenever about most_chars of them are held, so a task holds a batch of texts and little else."""
    types = (pa.int64(), pa.int32(), pa.int64(), pa.string())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], [key, "chunk_index", "start", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, text in zip(batch[0], batch[1]):  # one text at a time becomes a Python string
                number = i.as_py()
                for k, (start, chunk) in enumerate(cut(text.as_py() or "", size, overlap)):
                    rows.append((number, k, start, chunk))
                    held += len(chunk)
                    if held >= most_chars:
                        yield table(rows)
                        rows, held = [], 0
            yield table(rows)

    return run


def chunks(df: DataFrame, key: str, text: str, *, size: int = 1200, overlap: int = 200) -> DataFrame:
    """key, chunk_index, start and chunk of every text; empty and null texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    return df.select(F.col(key).cast("long"), text).mapInArrow(_cutting(key, size, overlap), f"{key} long, chunk_index int, start long, chunk string")
