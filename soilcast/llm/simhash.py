"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: lower-case A-Z, words, word shingles, XXH64 (seed 42) per shingle; a fingerprint bit is 1 if it is set
in over half of the shingle hashes.

Links: two fingerprints link at ``radius`` or fewer differing bits. A covering family of ``2^(radius+1) - 1`` bit
masks is built from a fixed map of bit positions to vectors of ``{0,1}^(radius+1)``: mask ``v`` keeps the positions
whose vector has an odd scalar product with ``v``. Any ``radius`` positions leave some non-zero ``v`` orthogonal to all
of them, so two fingerprints within the radius agree under that mask and meet in its table: no link is lost.

Scale: only distinct fingerprints enter the tables (a group of exact copies is one entry). Bucket sizes come from a
map-side combined count; buckets of one are dropped before any Python runs. A bucket larger than ``block`` is cut into
blocks, and every pair of blocks becomes its own group, so no group exceeds ``2 * block`` fingerprints and no pair is
lost. A group emits a spanning forest of its verified links, never all pairs. Components are joined by alternating
large-star and small-star steps on reliable checkpoints.

Nulls and edges: a null text counts as empty; a text without words has fingerprint 0, linked like any other; a null
doc_id keeps its row and links through its fingerprint, component_id is then the smallest non-null doc_id reachable
(null if there is none). Repeated rows and repeated ids are kept. Other columns are ignored, whatever their names.
"""
from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from soilcast.llm.common import cut_lineage, fresh, id_key, row_hash, ship, written

ship(__name__)

SHINGLE = 4
RADIUS = 4
BLOCK = 2048
MASK_SEED = 7
_CHUNK = 1 << 16


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text. Shingles are hashed in chunks, so a very long text needs bounded memory
    beside its own words."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # bytes: A-Z only, and exactly the contract's white space
    n = max(1, len(w) - shingle + 1) if w else 0
    if not n:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1:] if len(w) >= shingle else ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        a, b = starts[at:min(at + _CHUNK, n)].tolist(), last[at:at + _CHUNK].tolist()
        h = np.array([xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 keep: dict | None = None) -> DataFrame:
    """(id, fp long, plus the ``keep`` expressions): one row per document; fp is the signed 64-bit fingerprint."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(k) for k, c in (keep or {}).items()],
                      F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    names = ["doc_id", *(keep or {})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([text_fingerprint(t.as_py(), shingle) for t in b.column("t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fp, pa.int64())],
                                             names=[*names, "fp"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "t")
    return src.mapInArrow(run, f"{schema}, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = MASK_SEED) -> list[int]:
    """The ``2^(radius+1) - 1`` masks of the covering family, as signed 64-bit integers. Bit positions get the
    non-zero vectors in equal shares, in a seeded order, so every mask keeps about half of the bits."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    masks = []
    for v in range(1, size):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps`` (distinct): breadth-first, each step compares one fingerprint
    with those not reached yet."""
    out: list[tuple[int, int]] = []
    if len(fps) == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(a, b)] if (a ^ b).bit_count() <= radius else []
    left = fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return out


def candidate_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) that connect the same components as all links of the distinct fingerprints ``fp``."""
    masks = covering_masks(radius)
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
                           .alias("m", "k"))
    sizes = rows.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes an exploded table for as small as the fingerprints and would broadcast all the tables' rows
    met = rows.join(sizes.hint("merge"), ["m", "k"])
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), parts).cast("int")
    met = met.select("m", "k", "fp", parts.alias("p"), mine.alias("i"))
    pairs = F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("j")
    groups = met.select("m", "k", "fp", "i", pairs).select(
        "m", "k", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp")
    keys = ["m", "k", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by group; a group may span batches
        def emit(links):
            a = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        rest_key, rest = None, np.empty(0, np.uint64)
        links: list[tuple[int, int]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], 1)
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            for s, e in zip(bounds, bounds[1:]):
                key = tuple(cols[s])
                if key == rest_key:
                    rest = np.concatenate([rest, fp[s:e]])
                else:
                    links += spanning_links(rest, radius)
                    rest_key, rest = key, fp[s:e]
                if len(links) > _CHUNK:
                    yield emit(links)
                    links = []
        links += spanning_links(rest, radius)
        if links:
            yield emit(links)

    return (groups.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "a bigint, b bigint").dropDuplicates())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): connected components of links (a, b), root the smallest node; nodes without links are absent.

    Alternating large-star / small-star: every step replaces links by links to the smallest neighbour, by a map-side
    combined minimum and a join, until nothing changes. Every round is a reliable checkpoint."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"),
                                                                  F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        joined = both.join(low, both.a == low.u)
        if large:
            out = joined.where("b > a").select(F.col("b").alias("x"), "m")
        else:
            out = joined.select(F.col("b").alias("x"), "m").union(low.select(F.col("u").alias("x"), "m"))
        return out.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).dropDuplicates()

    def mark(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    e = cut_lineage(links.where("a <> b"))
    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = cut_lineage(star(star(e, True), False))
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    root = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.union(root.select("root", "root").dropDuplicates()) if before[0] else root


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, block: int = BLOCK, keep: dict | None = None) -> DataFrame:
    """One row per document: doc_id, the ``keep`` columns, fingerprint (16 hex digits), component_id, and group_key
    (the smallest fingerprint of the component, which names the group even where all its ids are null)."""
    fp = cut_lineage(fingerprints(docs, id_col, text_col, shingle, keep))
    classes = fp.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    comp = cut_lineage(components(candidate_links(classes.select("fp"), radius, block)))
    roots = comp.join(classes, comp.node == classes.fp).groupBy("root").agg(F.min("least_id").alias("comp_id"))
    linked = comp.join(roots, "root").select(F.col("node").alias("fp"), "comp_id", "root")
    # a written table forgets its partitioning: the last join deals both sides anew and can split a hot fingerprint
    ids = written(classes.join(linked, "fp", "left").select(
        "fp", F.when(F.col("root").isNotNull(), F.col("comp_id")).otherwise(F.col("least_id")).alias("component_id"),
        F.coalesce("root", "fp").alias("group_key")), "simhash-ids")
    return fp.join(ids, "fp").select("doc_id", *(keep or {}),
                                     F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                                     "group_key")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each near-duplicate group: the one with the
    smallest id (ties: smallest row hash; of rows equal in every column, one)."""
    h, k = fresh(docs, "row_hash_", "id_key_")
    hashed = row_hash(docs)
    near = near_duplicates(docs, id_col, text_col, shingle, radius, block, {"h": hashed})
    first = near.groupBy("group_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("r"))
    first = first.select(id_key("r.doc_id").alias(k), F.col("r.h").alias(h))
    marked = docs.withColumn(h, hashed).withColumn(k, id_key(id_col))
    return marked.join(first, [k, h]).dropDuplicates([k, h]).select(*[F.col(f"`{c}`") for c in docs.columns])
