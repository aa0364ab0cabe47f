import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from soilcast.llm import bm25 as S

from .helpers import SF, awkward, empty

WORD = re.compile(r"\w+")


def brute(rows, queries, k):
    docs = {i: Counter(WORD.findall((t or "").lower())) for i, t in rows}
    length = {i: sum(c.values()) for i, c in docs.items()}
    df = Counter(w for c in docs.values() for w in c)
    n, mean = len(rows), sum(length.values()) / len(rows)
    out = {}
    for q in queries:
        s = {}
        for i, c in docs.items():
            v = sum(qn * math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * c[w] * 2.2
                    / (c[w] + 1.2 * (.25 + .75 * length[i] / mean)) for w, qn in docs[q].items() if w in c)
            if v > 0:
                s[i] = v
        out[q] = sorted(((-round(v, 7), i) for i, v in s.items()))[:k]
    return out


@pytest.mark.parametrize("block, shard_postings", [(1, 10 ** 7), (4, 3000), (32, 10 ** 7)])
def test_top_k_equals_brute_force(spark, block, shard_postings):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = defaultdict(list)
    for r in S.top_k(df, F.col("doc_id") % 20 == 0, k=7, block=block, shard_postings=shard_postings).orderBy(
            "query_id", "rank").collect():
        got[r.query_id].append((-round(r.score, 7), r.doc_id))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 7)
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_pruning_leaves_blocks_closed():
    texts = [f"alpha beta w{i} w{i + 1}" for i in range(500)] + ["needle needle rare words here"]
    d, h, n, lengths = S.postings(texts)
    shard = S.Shard(d, h, n, lengths, float(lengths.mean()), block=4)
    qd, qh, _, _ = S.postings(["needle rare alpha"])
    opened = []
    real = np.partition

    def spy(a, kth):
        opened.append(int((a > 0).sum()))
        return real(a, kth)

    S.np.partition = spy
    try:
        docs, _ = shard.search(qh, np.array([1.0] * len(qh)), 1, 0.0)
    finally:
        S.np.partition = real
    assert docs.tolist() == [500] and max(opened) < 200


def test_search_awkward_rows(spark):
    df = awkward(spark)
    got = S.top_k(df, F.col("doc_id") >= 0, k=3).collect()
    asked = {r.query_id for r in got}
    assert {0, 4, 5, 6, 7} <= asked and not asked & {1, 2, 3}
    assert {(r.rank, r.doc_id) for r in got if r.query_id == 5} >= {(1, 5)}
    assert S.top_k(empty(spark), F.col("doc_id") >= 0).count() == 0
    assert S.top_k(df, F.lit(False)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii_surrogates",
                                                      "source_mixing", "best_fit_packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    out = corpus_pipeline.run(spark, SF)
    assert out.count() >= kept.count() > 0


def test_pipeline_on_awkward_and_empty_tables(spark):
    for df in (awkward(spark), empty(spark)):
        d = df
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
        d.count()
