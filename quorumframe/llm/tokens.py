"""Token ids of whole texts with a given tokenizer file, in tasks."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks of text that one worker keeps ids of.
MOST_CHUNKS = 1_500_000
_GROUP = 64


class ChunkTokenizer:
    """Encodes texts chunk by chunk and keeps the ids of chunks already seen.

    A chunk is a piece of text at whose ends the tokenizer splits anyway, so ids
    of a text are those of its chunks in a row: words without the white space
    where the tokenizer drops it, else words with the one space before them. A
    text that cannot be cut this way is encoded as a whole. New chunks are
    encoded many at a time, with a special token between them. Where words keep
    their space, Arrow cuts texts and numbers their words, so a word is looked up
    once for many texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = max(special.items(), key=lambda x: x[1])
        self.drops_space = len(self.tokenizer.encode(" a", add_special_tokens=False).ids) == len(self.tokenizer.encode("  a ", add_special_tokens=False).ids)
        self.kept: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _uncut(self, text: str) -> bool:
        """Whether it holds a special token's text, or what only Python takes for space."""
        return self.mark[:2] in text or any(c in text for c in "\0\x1c\x1d\x1e\x1f")

    def _learn(self, new: list[str]) -> None:
        if len(self.kept) + len(new) > MOST_CHUNKS:
            self.kept.clear()
        before = "" if self.drops_space else " "
        for at in range(0, len(new), _GROUP):
            part = new[at : at + _GROUP]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join([before + p for p in part])], add_special_tokens=False)[0].ids, self.dtype)  # without offsets
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            flat, start, wide = ids.tobytes(), 0, self.dtype.itemsize
            for chunk, cut in zip(part, [*cuts, len(ids)], strict=True):
                self.kept[chunk] = flat[start * wide : cut * wide]
                start = cut + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes of self.dtype; a null text is empty."""
        said = [t or "" for t in texts]
        whole = [self._uncut(t) for t in said]
        return self._words_alone(said, whole) if self.drops_space else self._words_with_space(said, whole)

    def _words_alone(self, texts: list[str], whole: list[bool]) -> list[bytes]:
        cut = [[] if w else t.split() for t, w in zip(texts, whole)]
        wanted = set().union(*cut)
        new = list(wanted.difference(self.kept))
        if len(self.kept) + len(new) > MOST_CHUNKS:
            new = list(wanted)
        if new:
            self._learn(new)
        kept = self.kept.__getitem__
        return [self.whole(t) if w else b"".join(map(kept, c)) for t, c, w in zip(texts, cut, whole)]

    def _words_with_space(self, texts: list[str], whole: list[bool]) -> list[bytes]:
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole)], pa.large_string()), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.dictionary_encode()
        wanted, numbers = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        # white space before the space of the next word takes part in how the tokenizer splits
        spaced = np.array([not w or w[-1].isspace() for w in wanted], bool)[numbers]
        first, last = bounds[:-1], bounds[1:] - 1
        spaced[last] = False
        starts = [wanted[k] for k in numbers[first].tolist()]
        spaced[first] &= np.array([s != "" for s in starts], bool)
        whole = (np.array(whole, bool) | (np.add.reduceat(spaced, first, dtype=np.int64) > 0)).tolist()
        ids = list(map(self.kept.get, wanted))
        new = [w for w, i in zip(wanted, ids) if i is None]
        if new:
            self._learn(wanted if len(self.kept) + len(new) > MOST_CHUNKS else new)
            ids = list(map(self.kept.__getitem__, wanted))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        at = (np.cumsum(sizes) - sizes)[numbers]
        lengths = sizes[numbers]
        lengths[first] = 0  # no space before it
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(ids), self.dtype)[np.repeat(at - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()
        upto = (ends[last] * self.dtype.itemsize).tolist()
        return [self.whole(t) if w else (self.whole(s) if s else b"") + flat[b:e] for t, w, s, b, e in zip(texts, whole, starts, [0, *upto], upto)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    """One for each path and worker."""
    return ChunkTokenizer(path)


def grouped(values: list, most_chars: int = 4_000_000):
    """Slices of a list of texts with a bounded number of characters (or one text)."""
    start, size = 0, 0
    for at, value in enumerate(values):
        size += len(value or "")
        if size >= most_chars:
            yield values[start : at + 1]
            start, size = at + 1, 0
    if start < len(values):
        yield values[start:]
