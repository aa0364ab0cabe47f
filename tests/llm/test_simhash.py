import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from soilcast.llm import simhash as S

from .helpers import awkward, empty


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids_fps):
    """doc index -> smallest id reachable, by all pairs."""
    group = list(range(len(ids_fps)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(f for _, f in ids_fps), 2):
        if (a ^ b).bit_count() <= 4:
            group[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(ids_fps):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids_fps))]


def test_masks_cover_every_pattern_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in S.covering_masks()]
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & x == 0 for m in masks)
    kept = [m.bit_count() for m in masks]
    assert min(kept) > 28 and max(kept) < 38


@pytest.mark.parametrize("text", ["", " \x0b", "A b", "a b c d", "Ä b C d e f\x1cg h", "x " * 70000, "a\x85b c d e"])
def test_fingerprint_equals_plain_form(text):
    assert S.text_fingerprint(text.encode()) == slow_fingerprint(text)


def test_spanning_links_join_what_all_pairs_join():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(30)})
    links = S.spanning_links(np.array(fps, np.uint64), 4)
    assert len(links) < len(fps) and all((a ^ b).bit_count() <= 4 for a, b in links)
    want = brute_components([(f, f) for f in fps])
    roots = {f: f for f in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in links:
        roots[find(a)] = find(b)
    assert len({find(f) for f in fps}) == len(set(want))


def test_components_with_small_blocks_equal_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        t = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.choice([1, 2, 15])):
            u = list(t)
            for _ in range(rng.randint(0, 2)):
                u[rng.randrange(len(u))] = rng.choice(words)
            texts.append(" ".join(u))
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    want = dict(zip((i for i, _ in rows), brute_components(fps)))
    for block in (2, S.BLOCK):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df, block=block).collect()}
        assert got == {i: (f"{f:016x}", want[i]) for i, f in fps}
    kept = sorted(r.doc_id for r in S.keep_first(df).collect())
    assert kept == sorted(set(want.values()))


def test_awkward_rows(spark):
    df = awkward(spark)
    got = S.near_duplicates(df).collect()
    assert len(got) == df.count()
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{slow_fingerprint(texts[r.doc_id]):016x}"
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1  # no words: fingerprint 0, linked
    assert by[4] == by[8] == 4 and by[None] is None
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and {0, 1, 4}.issubset(ids) and not {2, 3, 8} & set(ids)
    assert S.near_duplicates(empty(spark)).count() == 0 and S.keep_first(empty(spark)).count() == 0


def test_null_ids_link_through_their_fingerprint(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (None, "z")],
                               "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=repr)
    assert got == [(7, 7), (None, 7), (None, 7), (None, None)]
    assert S.keep_first(df).count() == 2


def test_the_masked_rows_are_not_broadcast(spark):
    """31 rows a fingerprint, which Spark takes for as small as the fingerprints: one broadcast of them filled the driver."""
    distinct = spark.range(500).select(F.xxhash64("id").alias("fp"))
    links = S.candidate_links(distinct)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert links.where("bit_count(a ^ b) > 4").count() == 0
