import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quorumframe.llm.packing import hilbert_key, pack, projected
from quorumframe.llm.records import frame, read_digests, unframe, write_records
from quorumframe.llm.tokens import ChunkTokenizer

TEXTS = [
    None, "", " ", "a", " a", "a ", "  a  b", "don't you'll I'M we've", "x\ny", "x \ny", "x\n z", "tab\t tab", "\x1c \x85 é　 z", "naïve ＡＢＣ é ́x",
    "<|endoftext|> and <|startoftext|>", "<|", "12345 6.7%%% ###", "a\0 b", "ΑΣ ΣΑΣ", "混じり 文字 🎉 ok", " ".join(f"wörd{k}" for k in range(30_000)), "a" * 3000,
]


def _crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    path = public_tokenizers.path(name)
    plain, chunked = Tokenizer.from_file(path), ChunkTokenizer(path)
    draw = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "é", "'s", "1", ".", "_", " ", "ß", "\r\n", "🎉", "'", "x y"]
    texts = TEXTS + ["".join(draw.choices(parts, k=draw.randrange(1, 30))) for _ in range(2000)]
    for text, got in zip(texts, chunked.encode(texts)):
        assert np.frombuffer(got, chunked.dtype).tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_a_word_is_looked_up_once_for_many_texts():
    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

        def get(self, word):
            Counted.asked += 1
            return super().get(word)

    chunked = ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    chunked.kept = Counted()
    assert len(set(chunked.encode(["one two three"] * 1000))) == 1 and Counted.asked < 20
    assert chunked.encode([]) == []


def _docs(spark):
    rows = [(k * 7 % 23, t) for k, t in enumerate(TEXTS)] + [(5, "again"), (5, "again"), (None, "of nobody"), (None, None)]
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(5)


def test_records(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, docs = Tokenizer.from_file(path), _docs(spark)
    folder, index = write_records(docs, path)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_digests(folder, index).collect()), key=lambda g: g[0])
    assert [g[1] for g in got] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i))  # those without an id come last
    assert [g[0] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    ids = {(r.doc_id, _crc(plain.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in docs.collect()}
    assert {(g[1], g[3]) for g in got} == ids
    shuffled = sorted(r.ids_crc32 for r in read_digests(folder, index.orderBy("length")).collect())
    assert shuffled == sorted(g[3] for g in got)
    assert read_digests(*write_records(docs.where("false"), path)).count() == 0


def test_damaged_records_are_found():
    record = frame(-7, np.array([1, 2, 60_000], "<u2").tobytes(), 2)
    doc_id, ids = unframe(record)
    assert doc_id == -7 and ids.tolist() == [1, 2, 60_000]
    for at in range(len(record)):
        with pytest.raises(ValueError):
            unframe(record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :])
    with pytest.raises(ValueError):
        unframe(record + b"x")


def test_pack_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, docs = Tokenizer.from_file(path), _docs(spark)
    pieces = pack(docs, path, length=64).collect()
    whole = sorted((r.doc_id, _crc(plain.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in docs.collect() if r.doc_id not in (5, None))
    assert sum(p.length for p in pieces if p.doc_id is None) == sum(len(plain.encode(t, add_special_tokens=False).ids) + 1 for t in ("of nobody", ""))  # two rows
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    assert sorted(by) == list(range(len(by)))
    for k, own in by.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert sum(p.length for p in own) == 64 or k == len(by) - 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc_id, _ in whole:
        ids = plain.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1]
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert all(p.ids_crc32 == _crc(ids[p.start : p.start + p.length]) and p.doc_tokens == len(ids) for p in own)
        assert sum(p.length for p in own) == len(ids)
    assert pack(docs.where("false"), path).count() == 0


def test_hilbert_curve_visits_each_cell_once_and_moves_by_one():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_key(cells, bits=3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_documents_lie_along_the_curve_and_neighbours_share_sequences(spark):
    """The order is that of keys computed one by one; documents of one vocabulary fill sequences together far more often than by chance."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, draw = Tokenizer.from_file(path), random.Random(5)
    topics = [[f"{a}{b}" for b in ("man", "tion", "ver", "lo", "ness", "able")] for a in ("car", "house", "green", "water", "stone")]
    rows = [(k, " ".join(draw.choices(topics[k % 5], k=40))) for k in range(200)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int").repartition(6)
    pieces = pack(docs, path, length=512).collect()
    at = {p.doc_id: (p.sequence_id, p.offset) for p in pieces if p.start == 0}
    ids = {k: plain.encode(t, add_special_tokens=False).ids for k, t in rows}
    keys = {k: int(hilbert_key(projected(np.array(i), plain.get_vocab_size())[None, :])[0]) for k, i in ids.items()}
    ordered = sorted(at, key=at.get)
    assert ordered == sorted(keys, key=lambda k: (keys[k], k))
    alike = [a % 5 == b % 5 for a, b in zip(ordered, ordered[1:]) if at[a][0] == at[b][0]]
    assert sum(alike) / len(alike) > 0.5  # a fifth by chance
