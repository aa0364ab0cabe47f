"""Forced-boundary BPE against the untouched tokenizers library."""
import hashlib
import random

import numpy as np
import pytest

from soilcast.llm import forced_bpe, tokens
from tests.llm.helpers import SF, awkward, empty, rows_of

PATH = tokens.vocabulary_path(tokens.BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture()
def enc():
    return forced_bpe.Encoder(PATH)


def check(enc, library, texts):
    ids, sizes = enc.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got, at = [], 0
    for n in sizes.tolist():
        got.append(ids[at:at + n].tolist())
        at += n
    assert got == want
    assert enc.decode(ids, sizes) == [library.decode(w, skip_special_tokens=False) for w in want]
    assert enc.decimals(ids, sizes) == [",".join(map(str, w)).encode() for w in want]


def odd_texts(n, seed=3):
    r = random.Random(seed)
    signs = [*" \n\t'stremvdlaZ09!.,<|>\u0085 　éñ你ж٣²½́\x1c\x00😀", "<|endoftext|>", "'ll", "'re", "  ",
             "\n\n", " '", "'s", "\r\n"]
    return ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(n)]


def test_odd_texts_equal_the_library(enc, library):
    check(enc, library, odd_texts(15000))


def test_every_code_point_class(enc, library):
    r = random.Random(5)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    check(enc, library, ["".join(map(chr, r.choices(points[:0x30000], k=20))) for _ in range(2000)])


def test_long_fragments_long_texts_and_slices(enc, library, monkeypatch):
    check(enc, library, ["a" * 50000, "ab" * 5000 + " " * 3000 + "x", "\n" * 5000, "hello world, it's me " * 20000])
    monkeypatch.setattr(forced_bpe, "SLICE", 40)
    check(enc, library, odd_texts(2000, 7) + ["word " * 500 + "<|endoftext|>" + " more" * 300])


def test_a_full_cache_forgets_and_stays_right(enc, library, monkeypatch):
    monkeypatch.setattr(forced_bpe, "CACHE", 300)
    monkeypatch.setattr(forced_bpe, "KEPT", 50)
    for seed in range(5):
        check(enc, library, odd_texts(300, seed))


def test_forced_cuts_never_lie_inside_a_token(enc):
    for b in enc.v.bytes[:50256:7]:
        assert all(enc.v.inside[x << 8 | y] for x, y in zip(b, b[1:]))
    assert 0 < enc.v.inside.mean() < 0.5     # most pairs force a cut


def test_decode_of_ids_that_are_no_text(enc, library):
    import numpy as np

    r = random.Random(1)
    lists = [[r.randrange(50257) for _ in range(r.randint(0, 12))] for _ in range(3000)]
    ids = np.array([i for x in lists for i in x], np.int64)
    assert enc.decode(ids, np.array(list(map(len, lists)))) == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        forced_bpe.Vocabulary(tokens.vocabulary_path(tokens.WORD_BPE))


def test_query_over_awkward_and_empty_tables(spark, library):
    docs = awkward(spark, ["", None, "it's  a<|endoftext|>b\n\nc", "x" * 3000, "naïve 你好", " "])
    got = rows_of(forced_bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert forced_bpe.round_trip(empty(spark)).count() == 0
    back = forced_bpe.decode_ids(forced_bpe.encode_texts(docs))
    assert rows_of(back, "doc_id", "text") == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)


def test_query_on_the_whole_table(spark, library):
    from soilcast.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = rows_of(QUERIES["op11_forced_boundary_bpe"](spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=repr)


def test_fragment_numbers_by_the_batch():
    """Equal fragments get one number, also across batches, growth of the table and forgetting; zero bytes count."""
    rnd, known, numbers = random.Random(3), {}, forced_bpe._Numbers()
    for _ in range(6):
        parts = [bytes(rnd.choices((0, 1, 97, 255), k=rnd.randint(1, 10))) for _ in range(20_000)]
        places = np.cumsum([0, *map(len, parts[:-1])])
        got = numbers.of(b"".join(parts), places).tolist()
        for p, n in zip(parts, got):
            assert known.setdefault(p, n) == n
        assert len(set(known.values())) == len(known) == numbers.count
    assert {known[p] for p in known} == set(range(numbers.count)) and numbers.new[known[parts[0]]] == parts[0]
    numbers.shrink(100)
    kept = [p for p, n in known.items() if n < 100]
    assert numbers.of(b"".join(kept), np.cumsum([0, *map(len, kept[:-1])])).tolist() == [known[p] for p in kept]
    assert numbers.count == 100
