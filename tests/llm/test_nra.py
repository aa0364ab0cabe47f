"""NRA search against full scores of every document."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from soilcast.llm import nra
from tests.llm.helpers import awkward, empty

PATTERN = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """docs: [(id, text)]; items: [(id, text)]; rows (item_id, rank, doc_id, score)."""
    tf = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in {x: None for x in items if x[1] is not None}:
        scores = []
        for i, c in tf:
            n, s = sum(c.values()), 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * (1000000000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total)))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if x else i, -s) for r, (s, x, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed, n_docs=300, n_items=25):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["Éa", "été", "A", "a", "你好"]
    text = lambda n: " ".join(r.choices(words, k=n))
    docs = [(i, text(r.randint(0, 60))) for i in range(n_docs)]
    docs += [(1000 + i, docs[5][1]) for i in range(15)]          # ties
    return docs, [(i, text(r.randint(0, 12))) for i in range(n_items)]


@pytest.mark.parametrize("shard", [40, 1000, 2_000_000])
def test_equals_full_scoring(spark, shard):
    docs, items = made(shard)
    got = nra.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                     spark.createDataFrame(items, "item_id long, text string"), shard_postings=shard, items_per_pass=10)
    assert rows(got) == brute(docs, items)


def test_awkward_documents_and_items(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "two one ONE", "x"), (1, "two one ONE", "x"), (1, "lorem amet", "y"), (2, None, "z"),
                                   (3, "", "z"), (None, "x world ñandú", None), (4, "!!", "q")],
                                  "item_id long, text string, score string")
    plain = [(r.item_id, r.text) for r in items.collect()]
    assert rows(nra.ranked(docs, items)) == brute([(r.doc_id, r.text) for r in docs.collect()], plain)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert nra.ranked(empty(spark), items).count() == 0
    assert nra.ranked(awkward(spark), items.where("false")).count() == 0


def test_reading_stops_early_and_scores_are_final():
    """A shard with one clear answer reads only the fronts of its lists; the bounds of the rest prove it."""
    n = 50_000
    doc = np.concatenate([np.arange(n), [7]])
    term = np.concatenate([np.zeros(n, np.int64), [1]])
    count = np.ones(n + 1, np.int64)
    count[7] = 50
    shard = nra.Shard(doc, term, count, np.full(n, 100, np.int64), n, 100 * n)
    reads = []
    real = nra._spread
    nra._spread = lambda first, lengths: reads.append(int(lengths.sum())) or real(first, lengths)
    try:
        d, s = shard.search(np.array([0, 1]), np.array([10, 5000]), 1, 1)
    finally:
        nra._spread = real
    assert d.tolist() == [7] and sum(reads) < 1000
    m = 25 + 75 * 100 * n // (100 * n)
    assert s[0] == 10 * (50 * 10**9 // (50000 + 8 * m)) + 5000 * (10**9 // (1000 + 8 * m))


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Abc déf-12 " * 500).encode()
    whole = [t for part in nra.terms_of(text) for t in part]
    monkeypatch.setattr(nra, "_PART", 64)
    assert [t for part in nra.terms_of(text) for t in part] == whole
