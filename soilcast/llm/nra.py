"""Ranked lexical search without random access (NRA) over impact-sorted posting lists.

For every item the k documents with the highest scores are found. A document's score is the sum over the item's terms
(repeats included) of ``w * ((10^9 tf) div (1000 tf + 8 m))``, all in 64-bit integers, with ``m = 25 + (75 n N) div L``
and ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; terms are runs of ASCII letters, digits and code points over U+007F,
A-Z lower-cased.

Shards hold, per term, the postings in order of falling impact. An item reads its lists from the front only, in steps
that grow. Every document met has a lower bound (what has been read of it) and an upper bound (that, plus the next
impact of each list in which it has not been met); a document not met yet is bounded by the sum of the next impacts.
Reading goes on until no document outside the best k, met or not, can reach the k-th lower bound, and every document
that can has equal bounds: membership, ties and scores are then exact. Nothing is ever looked up by document.

Steps: the items' terms are numbered (a table bounded by the query set, dealt in blocks of ``ITEMS`` items). One pass
over the texts writes, per document, its length and the counts of numbered terms. N, L and df come from that table. A
second pass cuts it into shards and answers all items of the block; a task carries each item's best k from shard to
shard, so its threshold starts where the last shard left it, and reports them once. The merge is a partial top-n.

Scale: no posting is shuffled; a shard holds about ``SHARD_POSTINGS`` postings; a task reports at most k rows an item.
Work beyond reading the texts is items times the part of their lists that is read.

Nulls and edges: a null text, or one without a term, is no document, and as an item it finds nothing; scores of 0 are
not returned; equal scores go by ascending doc_id, a null id last; repeated documents are each found; a repeated
(item_id, text) is one item, an item_id with several texts is answered for each; a null item_id is an id; empty tables
give no rows; other columns are ignored. Very long texts are read in slices.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from soilcast.llm.common import file_system, run_folder, ship, worker_state, written

ship(__name__)

TOP_K = 10
ITEMS = 50_000               # items answered in one pass over the shards
SHARD_POSTINGS = 2_000_000
FIRST_STEP, STEP_FACTOR = 256, 4
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_PART = 4 << 20              # bytes of a text whose terms are held at once
_CORPUS_TERMS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in order, a list per slice."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _PART) if len(text) - at > _PART else None
        end = gap.end() if gap else len(text)
        yield _TERM.findall(text[at:end].lower())   # bytes.lower() changes A-Z alone
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """(item_key, item_id, term, times) per distinct (item_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for b in batches:
            rows = []
            for key, item, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                c = Counter()
                for part in terms_of(text):
                    c.update(part)
                rows += [(key, item, t, n) for t, n in c.items()]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                     pa.array(cols[3], pa.int64())], names=["item_key", "item_id", "term", "times"])

    return items.mapInArrow(run, "item_key bigint, item_id bigint, term binary, times bigint")


def _load(folder: str):
    """The table written to ``folder``, for use inside tasks."""
    import pyarrow.dataset as ds

    fs, path = file_system(folder)
    return ds.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=True).to_table(use_threads=False)


def corpus_terms(docs: DataFrame, numbers: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: its number of terms, and how often the terms numbered
    in the table at ``numbers`` occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("nra_numbers")
        if state.get("of") != numbers:
            t = _load(numbers)
            state.update(of=numbers, index=dict(zip(t.column("term").to_pylist(), t.column("number").to_pylist())))
        get = state["index"].get
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                piece = b.slice(at, 1000)
                n, flat = np.zeros(piece.num_rows, np.int64), []
                for i, text in enumerate(piece.column(1).to_pylist()):
                    for part in terms_of(text):
                        n[i] += len(part)
                        x = np.fromiter(map(get, part, repeat(-1)), np.int64, len(part))
                        flat.append((x[x >= 0]) | (i << 32))
                key, count = np.unique(np.concatenate(flat), return_counts=True) if flat else (np.empty(0, np.int64),) * 2
                keep = n > 0
                ends = np.concatenate([[0], np.cumsum(np.bincount(key >> 32, minlength=len(n))[keep])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).filter(pa.array(keep)), pa.array(n[keep]),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array((key & 0xFFFFFFFF).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(count.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, _CORPUS_TERMS)


def document_frequency(corpus: DataFrame) -> DataFrame:
    """(number, df): every partition counts its own documents first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(total))
            n[:len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))],
                                         names=["number", "n"])

    return corpus.select("terms").mapInArrow(run, "number int, n bigint").groupBy("number").agg(F.sum("n").alias("df"))


def weights(df: DataFrame, n_docs: int) -> DataFrame:
    """(number, w)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.int64())], names=["number", "w"])

    return df.select("number", "df").mapInArrow(run, "number int, w bigint")


def _spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """Impact-sorted posting lists of a bounded set of documents, which are numbered in order of ties."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int):
        big = 75 * int(n.max(initial=0)) * n_docs >= 1 << 63
        m = 25 + (np.array([75 * int(x) * n_docs // n_terms for x in n], np.int64) if big
                  else 75 * n * n_docs // n_terms)
        impact = 1_000_000_000 * count // (1000 * count + 8 * m[doc])
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        term = term[order]
        new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        self.terms, self.first = term[new], np.append(new, len(term))
        self.n_docs = len(n)

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the best k with a score of ``least`` (1 or more) at least, best first."""
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(self.terms):
            return nothing
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = (self.terms[at] == terms) & (weight > 0)
        at, weight = at[here], weight[here]
        head, end = self.first[at], self.first[at + 1]
        low = np.zeros(self.n_docs, np.int64)
        met_doc, met_list = np.empty(0, np.int64), np.empty(0, np.int64)
        step = FIRST_STEP
        impact = np.append(self.impact, 0)
        while True:
            ahead = np.where(head < end, weight * impact[head], 0)      # the most that a list can still give
            unseen = int(ahead.sum())
            met = np.zeros(self.n_docs, bool)
            met[met_doc] = True
            seen = np.flatnonzero(met)
            bar = least
            if len(seen) >= k:
                bar = max(least, int(np.partition(low[seen], len(seen) - k)[len(seen) - k]))
            given = np.zeros(self.n_docs, np.int64)
            np.add.at(given, met_doc, ahead[met_list])
            slack = unseen - given[seen]
            can = low[seen] + slack >= bar
            if unseen == 0 or (unseen < bar and not (can & (slack > 0)).any()):
                found = seen[can]
                found = found[np.lexsort((found, -low[found]))][:k]
                return found, low[found]
            take = np.minimum(end - head, step)
            lists = np.repeat(np.arange(len(head)), take)
            read = _spread(head, take)
            d = self.doc[read]
            np.add.at(low, d, weight[lists] * self.impact[read])
            met_doc, met_list = np.concatenate([met_doc, d]), np.concatenate([met_list, lists])
            head = head + take
            step *= STEP_FACTOR


class _Best:
    """The best k of each item so far: scores, ids and which ids are null, kept in order."""

    def __init__(self, n_items: int, k: int):
        self.score = np.zeros((n_items, k), np.int64)
        self.id = np.zeros((n_items, k), np.int64)
        self.null = np.zeros((n_items, k), bool)

    def least(self, item: int) -> int:
        return max(1, int(self.score[item, -1]))

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        s, i, x = (np.concatenate([a[item], b]) for a, b in ((self.score, scores), (self.id, ids), (self.null, nulls)))
        order = np.lexsort((i, x, -s))[:self.score.shape[1]]
        self.score[item], self.id[item], self.null[item] = s[order], i[order], x[order]


def search(corpus: DataFrame, queries: str, n_docs: int, n_terms: int, k: int = TOP_K,
           shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_key, item_id, doc_id, score, rank): the best k documents of ``corpus`` for each item of the table written
    at ``queries`` (item_key, item_id, terms, weights)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None
        parts, held = [], 0

        def answer():
            ids = pa.concat_arrays([p[0] for p in parts])
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            order = np.lexsort((ids, null))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            size = np.concatenate([p[2] for p in parts])
            shard = Shard(np.repeat(place, size), np.concatenate([p[3] for p in parts]).astype(np.int64),
                          np.concatenate([p[4] for p in parts]).astype(np.int64),
                          np.concatenate([p[1] for p in parts])[order], n_docs, n_terms)
            for i, (terms, weight) in enumerate(asked):
                d, s = shard.search(terms, weight, k, best.least(i))
                if len(d):
                    d = order[d]
                    best.add(i, s, ids[d], null[d])

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                piece = b.slice(at, 1000)
                lists = piece.column(2)
                parts.append((piece.column(0), piece.column(1).to_numpy(),
                              pa.compute.list_value_length(lists).to_numpy().astype(np.int64),
                              lists.flatten().to_numpy(), piece.column(3).flatten().to_numpy()))
                held += len(parts[-1][3])
                if items is None:
                    items = _load(queries)
                    best = _Best(items.num_rows, k)
                    asked = [(np.array(t, np.int64), np.array(w, np.int64)) for t, w in zip(
                        items.column("terms").to_pylist(), items.column("weights").to_pylist())]
                if held >= shard_postings:
                    answer()
                    parts, held = [], 0
        if parts:
            answer()
        if items is not None:
            row, col = np.nonzero(best.score)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [items.column("item_key").combine_chunks().take(take), items.column("item_id").combine_chunks().take(take),
                 pa.array(best.id[row, col], mask=best.null[row, col]), pa.array(best.score[row, col])],
                names=["item_key", "item_id", "doc_id", "score"])

    found = corpus.select("doc_id", "n", "terms", "counts").mapInArrow(
        run, "item_key bigint, item_id bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("item_key", "item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", k: int = TOP_K, items_per_pass: int = ITEMS,
           shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item the ``k`` best documents, best first."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")) \
        .where("text is not null")
    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")) \
        .where("text is not null").distinct()
    asked = asked.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", F.col("text").cast("binary").alias("text"))
    terms = written(item_terms(asked), "nra-item-terms")
    numbered = run_folder(spark, "nra-numbers")
    by_term = Window.partitionBy("part").orderBy("term")
    # dense numbers without one sort of all terms: a running number in each of 64 parts, on top of the parts before it
    t = terms.select("term").distinct().select("term", F.pmod(F.xxhash64("term"), F.lit(64)).alias("part"))
    sizes = t.groupBy("part").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(
        F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))   # 64 rows
    t.join(F.broadcast(before), "part").select(
        "term", (F.col("before") + F.row_number().over(by_term) - 1).cast("int").alias("number")).write.parquet(numbered)
    corpus = written(corpus_terms(d, numbered), "nra-corpus")
    n_docs, n_terms = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = weights(document_frequency(corpus), n_docs)
    numbers = spark.read.parquet(numbered)
    weighted = written(
        terms.join(numbers.join(w, "number"), "term").select(
            "item_key", "item_id", "number", (F.col("w") * F.col("times")).alias("w"))
        .groupBy("item_key", "item_id").agg(F.sort_array(F.collect_list(F.struct("number", "w"))).alias("t"))  # one item's terms
        .select("item_key", "item_id", F.col("t.number").alias("terms"), F.col("t.w").alias("weights")), "nra-items")
    passes = max(1, -(-weighted.count() // items_per_pass))
    out = None
    for p in range(passes):
        path = run_folder(spark, "nra-queries")
        weighted.where(F.pmod("item_key", F.lit(passes)) == p).write.parquet(path)
        one = search(corpus, path, n_docs, n_terms, k, shard_postings)
        out = one if out is None else out.unionByName(one)
    return out.select("item_id", "rank", "doc_id", "score")
