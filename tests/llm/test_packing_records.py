import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from soilcast.llm import packing as P, records as R, tokens as T

from .helpers import SF, awkward, empty

ODD = ["", "  a  b \n\n c", "\n", "a\n \n b   ", "x\x1cy z", "é́ é E", "don't   I'M we'll  ", "　a b   c",
       "<|endoftext|> a<|startoftext|>", " 3 4 55 12,3", "ΑΣ Σ ΑΣΑ", "a \x01 b", "\t\tx\r\n y", "İ I ı", "🙂🙂 a🙂b"]


def library(name):
    t = Tokenizer.from_file(T.vocabulary_path(name))
    t.encode_special_tokens = True
    return t


def plain(name, texts):
    return [e.ids for e in library(name).encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", [T.BYTE_BPE, T.WORD_BPE])
def test_encoder_equals_library(name, monkeypatch):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" \n\t ab'sdé!.,1_ ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    enc = T.Encoder(T.vocabulary_path(name), T.LEADING[name])
    want = plain(name, texts)
    for _ in range(2):  # the second time from the cache
        assert [list(map(int, x)) for x in enc.encode(texts)] == want
    monkeypatch.setattr(T, "CACHE", 300)
    monkeypatch.setattr(T, "KEPT", 50)
    for at in range(0, len(texts), 40):  # the cache shrinks again and again
        assert [list(map(int, x)) for x in enc.encode(texts[at:at + 40])] == want[at:at + 40]
    monkeypatch.setattr(T, "_SLICE", 20)
    assert [list(map(int, x)) for x in enc.encode(texts)] == want


def test_packer_places_best_and_closes_the_fullest():
    p = P.Packer(10, 2)
    assert p.place(6) == (0, 0)          # free 4
    assert p.place(5) == (1, 0)          # free 5
    assert p.place(4) == (0, 6)          # the tightest fit, now full
    assert p.place(8) == (2, 0)          # free 2; bins 1 and 2 are open
    assert p.place(9) == (3, 0)          # bin 2, the fullest, closes
    assert p.place(2) == (1, 5)          # so 2 goes to bin 1
    rng = random.Random(1)
    p, used = P.Packer(100, 8), {}
    for _ in range(5000):
        n = rng.randint(1, 100)
        number, at = p.place(n)
        assert used.get(number, 0) == at and at + n <= 100 and p.open <= 8
        used[number] = at + n


def packed_ok(rows, docs, capacity):
    ids = dict(zip(docs, plain(T.WORD_BPE, docs.values())))
    bins, seen = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append(r)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, own in ids.items():
        own = np.array([*own, 0], "<u4")
        parts = sorted(seen[doc], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(own) // capacity)))
        for r in parts:
            cut = own[r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(cut.tobytes()) and r.length == min(capacity, len(own) - r.start)
    return len(bins)


def test_packing_is_whole_and_tight(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = P.pack_documents(df).collect()
    n = packed_ok(rows, {r.doc_id: r.text for r in df.collect()}, P.CAPACITY)
    assert n <= 1.05 * sum(r.length for r in rows) / P.CAPACITY + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, P.pack_documents(df).collect()))


def test_packing_with_ids_and_many_packers(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = P.pack_documents(df, keep_ids=True, tokens_per_packer=10_000).collect()
    assert len({r.sequence_id >> 40 for r in rows}) > 1
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_packing_awkward_rows(spark):
    df = awkward(spark)
    rows = P.pack_documents(df).collect()
    assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert sum(r.doc_id == 0 for r in rows) == 3 and any(r.doc_id is None for r in rows)
    assert P.pack_documents(empty(spark)).count() == 0


def test_crc32c_and_frames():
    assert int(R.crc32c([b"123456789"])[0]) == 0xE3069283  # the check value of CRC-32C
    rng = random.Random(1)
    blocks = [rng.randbytes(n) for n in (0, 1, 3, 4, 5, 100, 1023, 1024, 1025, 5000)]
    table = R._byte_table()

    def slow(b):
        v = 0xFFFFFFFF
        for x in b:
            v = int(table[(v ^ x) & 255]) ^ (v >> 8)
        return v ^ 0xFFFFFFFF

    assert [int(x) for x in R.crc32c(blocks)] == [slow(b) for b in blocks]
    data = b"".join(R.frame(blocks))
    assert R.unframe(data) == blocks
    for at in (2, 9, len(data) - 1, 60):
        with pytest.raises(Exception):
            R.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])


def test_records_round_trip(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    manifest = R.write_records(df, str(tmp_path), shard_bytes=20_000)
    assert manifest.count() > 3
    assert not list(tmp_path.glob("shards/_temporary*"))
    docs = sorted((r.doc_id, r.text) for r in df.collect())
    want, start = [], 0
    for (i, _), ids in zip(docs, plain(T.BYTE_BPE, [t for _, t in docs])):
        ids = np.array([*ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, R.read_records(spark, str(tmp_path)).collect())) == want
    # shuffled reads: one record through its index entry
    shard = manifest.orderBy("part", "roll").first()
    entry = np.fromfile(f"{shard.path}.idx", R.INDEX)[2]
    with open(f"{shard.path}.rec", "rb") as f:
        f.seek(int(entry["offset"]))
        (body,) = R.unframe(f.read(int(entry["bytes"]) + 16))
    assert zlib.crc32(np.frombuffer(body, "<u2").astype("<u4").tobytes()) == want[int(entry["doc_id"])][3]


def test_records_awkward_rows(spark):
    df = awkward(spark)
    rows = R.round_trip(df).collect()
    assert len(rows) == df.count()
    by_start = sorted(rows, key=lambda r: r.start)
    ids = [r.doc_id for r in by_start]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r.start for r in by_start] == list(np.cumsum([0] + [r.n_tokens for r in by_start[:-1]]))
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert R.round_trip(empty(spark)).count() == 0


def test_damaged_shard_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    R.write_records(df, str(tmp_path))
    (path,) = tmp_path.glob("shards/*.rec")
    data = bytearray(path.read_bytes())
    data[14] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged record"):
        R.read_records(spark, str(tmp_path)).collect()


def untouched(name, texts):
    """Ids of the library with the file as it is."""
    t = Tokenizer.from_file(T.vocabulary_path(name))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


SPECIAL = ["one text<|endoftext|>next text", "a <|startoftext|>  b", "<|endoftext|>", "<|EndOfText|> x",
           "<|end<|endoftext|>\n\n<|startoftext|>", "é<|endoftext|>́x  y"]


@pytest.mark.parametrize("name", [T.BYTE_BPE, T.WORD_BPE])
def test_operators_encoder_equals_the_untouched_library(name, monkeypatch):
    rng = random.Random(5)
    bits = [" ", "\n", "ab", "é", "'s", "12", "<|", "|>", "endoftext", "<|endoftext|>", "<|startoftext|>", "\x1c"]
    texts = ODD + SPECIAL + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    enc = T.encoder(T.vocabulary_path(name), T.LEADING[name])
    want = untouched(name, texts)
    for _ in range(2):  # the second time from the cache
        assert [list(map(int, x)) for x in enc.encode(texts)] == want
    monkeypatch.setattr(T, "_SLICE", 20)
    assert [list(map(int, x)) for x in enc.encode(texts)] == want


def test_added_tokens_in_documents(spark):
    docs = dict(enumerate(SPECIAL + ["plain words after them"]))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    ids = {i: np.array([*x, 0], "<u4") for i, x in zip(docs, untouched(T.WORD_BPE, list(docs.values())))}
    got = {r.doc_id: (r.length, r.ids_crc32) for r in P.pack_documents(df).collect()}
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}
    want, start = [], 0
    for i, x in zip(docs, untouched(T.BYTE_BPE, list(docs.values()))):
        x = np.array([*x, 0], "<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, R.round_trip(df).collect())) == want


def test_equal_parts_of_different_chunks_are_learnt_once():
    from types import SimpleNamespace

    enc = T.Encoder(T.vocabulary_path(T.WORD_BPE), False)
    whole, asked, model = enc.encode(["été (word) Word, word"]), [], enc.tok.model
    enc = T.Encoder(T.vocabulary_path(T.WORD_BPE), False)
    enc.model = SimpleNamespace(tokenize=lambda part: asked.append(part) or model.tokenize(part))
    assert [list(x) for x in enc.encode(["été (word) Word, word"])] == [list(x) for x in whole]
    assert "word" in asked and len(asked) == len(set(asked))
