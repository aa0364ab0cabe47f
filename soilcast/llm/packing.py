"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bounded-space online best-fit: a packer keeps at most ``open_bins`` bins open, in a bitset keyed by free space. A
piece goes to the open bin whose free space fits it most tightly; if none fits and all are open, the fullest bin closes
first. Full bins close at once.

A document is its ids plus an end id; only documents longer than the capacity are cut, into pieces of the capacity.

Scale: tokenising is one narrow pass and leaves one small row per piece (or the ids too, with ``keep_ids``). Pieces are
dealt by a hash over packers of about ``tokens_per_packer`` tokens, whatever document or source they come from, so no
group is hot; each packer streams its pieces in a seeded hash order with memory for the open bins only. Every packer
leaves at most ``open_bins`` bins that are not full, a fixed share of its many bins.

Nulls and edges: a null or empty text is a document of the end id alone; a null doc_id packs like any other; repeated
rows are packed each; an empty table gives no pieces; other columns are ignored. A retried task packs the same pieces
in the same order and gives the same sequence numbers.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from soilcast.llm import tokens
from soilcast.llm.common import cut_lineage, ship

ship(__name__)

CAPACITY = 2048
OPEN_BINS = 512
TOKENS_PER_PACKER = 1 << 24


class Packer:
    """Places piece lengths one by one; numbers of bins count up from 0 in the order they are opened."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f is set while some open bin has f places left
        self.bins: dict[int, list[int]] = {}
        self.opened = self.open = 0

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        number = stack.pop()
        if not stack:
            del self.bins[space]
            self.free ^= 1 << space
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of 1 to ``capacity`` tokens."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, number = self.capacity, self.opened
            self.opened += 1
        left = space - length
        if left:
            self.bins.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - space


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.WORD_BPE,
             capacity: int = CAPACITY, end_id: int = tokens.END_ID, keep_ids: bool = False,
             path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): one row per piece. ``path``: the vocabulary's file, else it
    is looked up by name on each executor."""
    leading = tokens.LEADING.get(vocabulary)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path or tokens.vocabulary_path(vocabulary), leading)
        for b in batches:
            rows, out = [], {k: [] for k in ("piece", "start", "length", "crc", "ids")}
            for k, ids in enumerate(enc.encode_bytes(b.column("text").to_pylist())):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    rows.append(k)
                    out["piece"].append(p), out["start"].append(at // 4), out["length"].append(len(cut) // 4)
                    out["crc"].append(zlib.crc32(cut)), out["ids"].append(cut if keep_ids else None)
            cols = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(out["piece"], pa.int32()),
                    *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc"))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(out["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return src.mapInArrow(run, schema + (", ids binary" if keep_ids else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         tokens_per_packer: int = TOKENS_PER_PACKER) -> DataFrame:
    """``pieces`` (any columns with ``length``) with sequence_id and offset."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // tokens_per_packer))
    order = [F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns if c != "ids"]),
             *[F.col(f"`{c}`") for c in pieces.columns if c != "ids"]]
    dealt = pieces.repartition(packers, order[0]).sortWithinPartitions(*order)
    dealt = dealt.withColumn("sequence_id", F.shiftleft(F.spark_partition_id().cast("long"), 40))
    fields = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, open_bins)
        for b in batches:
            placed = np.array([packer.place(n) for n in b.column("length").to_pylist()], np.int64).reshape(-1, 2)
            seq = b.column("sequence_id").to_numpy(zero_copy_only=False) + placed[:, 0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), pa.array(seq), pa.array(placed[:, 1])],
                                             names=[*fields, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
                   **options) -> DataFrame:
    """Pieces of ``docs`` with their places. The pieces are cut from their lineage once: packing needs their total
    first, and a lost executor then costs no second encoding."""
    return pack(cut_lineage(tokenise(docs, id_col, text_col, keep_ids=keep_ids)), **options)
