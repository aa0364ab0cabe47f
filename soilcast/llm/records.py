"""Token ids as length-delimited binary records with a separate offset index.

Record: payload length (8 bytes, little-endian), masked CRC-32C of these 8 bytes, payload, masked CRC-32C of the
payload: the framing of TFRecord files. Payload: the document's ids as little-endian unsigned integers of the width
that the vocabulary needs (2 bytes up to 65,536 ids, else 4). Index (``.idx`` beside every shard): per record the byte
offset, payload bytes, the document's id (with a flag for null) and the ids before it in the shard, so a reader can
fetch records in any order. The manifest, a Parquet table in the run's folder, has a row per shard.

Scale: documents are range-partitioned by id (and by a text hash inside one id, so a repeated id is no hot range),
sorted inside a partition, encoded there and written at once: the text is shuffled once, the ids never. Shards roll at
``shard_bytes``. A task writes under temporary names and renames when a shard is whole; a retried task writes the same
bytes under the same final names, so a lost executor leaves nothing half-written behind a final name. Only manifest
rows, one per shard, come back; the running total over shards is a window over these few rows.

Nulls and edges: a null or empty text is a document of the end id alone; null ids come first; rows that repeat an id
are ordered by text hash and text, equal rows follow one another; an empty table gives no shard; other columns are
ignored. Reading verifies both checksums and raises on a damaged record.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from soilcast.llm import forced_bpe, tokens
from soilcast.llm.common import dealt_shards, file_system, run_folder, ship

ship(__name__)

SHARD_BYTES = 128 << 20
READ_BYTES = 8 << 20
MASK_DELTA = 0xA282EAD8
_ROW = 1024  # bytes per step row of the checksum
INDEX = np.dtype([("offset", "<i8"), ("bytes", "<i8"), ("doc_id", "<i8"), ("has_id", "<i8"), ("start", "<i8")])
MANIFEST = ("shard string, path string, part int, roll int, n_docs bigint, n_tokens bigint, n_bytes bigint, "
            "width int, digest string")


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0x82F63B78), t >> np.uint32(1))
    return t


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(8 tables for 8 bytes at once, 4 tables that shift a checksum over _ROW zero bytes)."""
    eight = np.zeros((8, 256), np.uint32)
    eight[0] = _byte_table()
    for k in range(1, 8):
        eight[k] = eight[0][eight[k - 1] & 255] ^ (eight[k - 1] >> np.uint32(8))
    shift = np.zeros((4, 256), np.uint32)
    for k in range(4):
        v = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(_ROW):
            v = eight[0][v & 255] ^ (v >> np.uint32(8))
        shift[k] = v
    return eight, shift


def crc32c(blocks: list[bytes]) -> np.ndarray:
    """CRC-32C of each block. Blocks are laid out in rows of _ROW bytes with zeros in front (zeros before the first
    byte change nothing once the register starts at 0), all rows advance together, then rows are joined per block."""
    eight, shift = _TABLES if _TABLES else _fill_tables()
    out = np.zeros(len(blocks), np.uint32)
    width = _ROW if max(map(len, blocks), default=0) > 8 else 8  # the 8-byte lengths need no long rows
    rows = [max(1, -(-max(4, len(b)) // width)) for b in blocks]
    buf = np.zeros((sum(rows), width), np.uint8)
    flat, at, short = buf.reshape(-1), 0, []
    for k, (b, n) in enumerate(zip(blocks, rows)):
        at += n * width
        if len(b) < 4:
            short.append(k)
            continue
        flat[at - len(b):at] = np.frombuffer(b, np.uint8)
        flat[at - len(b):at - len(b) + 4] ^= 0xFF  # the register's start value, on the first four bytes
    reg = np.zeros(len(buf), np.uint32)
    words = buf.view("<u4")
    for j in range(0, width // 4, 2):
        a, b = words[:, j] ^ reg, words[:, j + 1]
        reg = (eight[7][a & 255] ^ eight[6][(a >> 8) & 255] ^ eight[5][(a >> 16) & 255] ^ eight[4][a >> 24]
               ^ eight[3][b & 255] ^ eight[2][(b >> 8) & 255] ^ eight[1][(b >> 16) & 255] ^ eight[0][b >> 24])
    first = np.cumsum([0, *rows[:-1]])
    left = np.array(rows)
    out = reg[first] if len(rows) else out
    step = 1
    while (left > step).any():
        on = np.flatnonzero(left > step)
        v = out[on]
        out[on] = (shift[0][v & 255] ^ shift[1][(v >> 8) & 255] ^ shift[2][(v >> 16) & 255] ^ shift[3][v >> 24]
                   ^ reg[first[on] + step])
        step += 1
    out = out ^ np.uint32(0xFFFFFFFF)
    for k in short:
        v = 0xFFFFFFFF
        for byte in blocks[k]:
            v = int(eight[0][(v ^ byte) & 255]) ^ (v >> 8)
        out[k] = v ^ 0xFFFFFFFF
    return out


_TABLES: tuple = ()


def _fill_tables() -> tuple:
    global _TABLES
    _TABLES = _tables()
    return _TABLES


def masked(crc: np.ndarray) -> np.ndarray:
    c = crc.astype(np.uint64)
    return (((c >> np.uint64(15)) | (c << np.uint64(17))) + np.uint64(MASK_DELTA)).astype(np.uint32)


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    head_crc, body_crc = masked(crc32c(heads)), masked(crc32c(payloads))
    return [b"".join((h, struct.pack("<I", int(a)), p, struct.pack("<I", int(b))))
            for h, a, p, b in zip(heads, head_crc, payloads, body_crc)]


def unframe(data: bytes) -> list[bytes]:
    """Payloads of whole records; raises on a damaged one."""
    heads, bodies, sums, at = [], [], [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        heads.append(data[at:at + 8])
        bodies.append(data[at + 12:at + 12 + n])
        sums.append((struct.unpack_from("<I", data, at + 8)[0], struct.unpack_from("<I", data, at + 12 + n)[0]))
        at += n + 16
    got = np.stack([masked(crc32c(heads)), masked(crc32c(bodies))], 1) if heads else np.empty((0, 2), np.uint32)
    if not np.array_equal(got, np.array(sums, np.uint32).reshape(-1, 2)):
        raise ValueError("damaged record")
    return bodies


class _Shard:
    """One shard and its index under temporary names until ``close``."""

    def __init__(self, folder: str, part: int, roll: int, attempt: str):
        self.fs, base = file_system(folder)
        self.name, self.part, self.roll = f"part-{part:06d}-{roll:04d}", part, roll
        self.final = f"{base}/{self.name}"
        self.temp = f"{base}/_temporary-{attempt}-{self.name}"
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.temp}.rec")
        self.docs = self.bytes = self.tokens = 0
        self.digest = 0
        self.index: list[np.ndarray] = []

    def add(self, records: list[bytes], payload_bytes: np.ndarray, doc_ids: list, n: np.ndarray):
        """Appends whole records with one write."""
        row = np.zeros(len(records), INDEX)
        size = payload_bytes + 16
        row["offset"] = self.bytes + np.cumsum(size) - size
        row["bytes"] = payload_bytes
        row["doc_id"] = [0 if d is None else d for d in doc_ids]
        row["has_id"] = [d is not None for d in doc_ids]
        row["start"] = self.tokens + np.cumsum(n) - n
        self.index.append(row)
        data = b"".join(records)
        self.out.write(data)
        self.digest = zlib.crc32(data, self.digest)
        self.docs += len(records)
        self.bytes += len(data)
        self.tokens += int(n.sum())

    def close(self) -> None:
        self.out.close()
        with self.fs.open_output_stream(f"{self.temp}.idx") as f:
            f.write(np.concatenate(self.index).tobytes())
        for end in (".idx", ".rec"):
            self.fs.move(f"{self.temp}{end}", f"{self.final}{end}")

    def row(self, folder: str, width: int) -> list:
        return [self.name, f"{folder}/{self.name}", self.part, self.roll, self.docs, self.tokens, self.bytes,
                width, f"{self.digest:08x}"]


def _encoding(path: str, leading: bool | None):
    """(function from texts to all ids and ids per text, size of the vocabulary): by forced boundaries for the byte-level
    vocabulary, else through the library."""
    if leading:
        enc = forced_bpe.encoder(path)
        return enc.encode, enc.v.size
    enc = tokens.encoder(path, leading)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = enc.encode(texts)
        return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))

    return encode, enc.tok.get_vocab_size()


def write_records(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                  vocabulary: str = tokens.BYTE_BPE, end_id: int = tokens.END_ID, shard_bytes: int = SHARD_BYTES,
                  path: str | None = None) -> DataFrame:
    """Writes shards, indexes and the manifest below ``folder`` (shared by all executors); returns the manifest."""
    spark = docs.sparkSession
    leading = tokens.LEADING.get(vocabulary)
    key = F.xxhash64("text")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("h", key).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    src = src.select("doc_id", "text", F.spark_partition_id().alias("part"))
    shards = f"{folder}/shards"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        encode, vocabulary_size = _encoding(path or tokens.vocabulary_path(vocabulary), leading)
        width = 2 if vocabulary_size <= 1 << 16 else 4
        shard, roll, attempt, rows = None, 0, uuid.uuid4().hex, []
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                ids, n = encode(part.column("text").to_pylist())
                n = n + 1
                ends = np.cumsum(n)
                last = np.zeros(int(ends[-1]), bool)
                last[ends - 1] = True
                flat = np.full(len(last), end_id, f"<u{width}")
                flat[~last] = ids
                raw, cuts, docs_ = flat.tobytes(), (ends * width).tolist(), part.column("doc_id").to_pylist()
                records, size = frame([raw[s:e] for s, e in zip([0, *cuts], cuts)]), n * width
                written, done = np.cumsum(size + 16), 0
                while done < len(records):
                    before = int(written[done - 1]) if done else 0
                    if shard and shard.bytes + int(written[done]) - before > shard_bytes:
                        shard.close()
                        rows.append(shard.row(shards, width))
                        shard, roll = None, roll + 1
                    if not shard:
                        shard = _Shard(shards, part.column("part")[0].as_py(), roll, attempt)
                    # as many as the shard takes, one at least
                    stop = max(done + 1, int(np.searchsorted(written, shard_bytes - shard.bytes + before, "right")))
                    shard.add(records[done:stop], size[done:stop], docs_[done:stop], n[done:stop])
                    done = stop
        if shard:
            shard.close()
            rows.append(shard.row(shards, width))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=_ARROW)

    src.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


_NAMES = [x.split()[0] for x in MANIFEST.split(", ")]
_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[x.split()[1]])
                    for x in MANIFEST.split(", ")])


def read_records(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every record, read back from the shards by their manifest."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "roll").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", "path", "n_docs", "n_bytes", "width", "digest", before.alias("before"))
    shards = dealt_shards(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                fs, base = file_system(s["path"])
                with fs.open_input_stream(f"{base}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                if len(index) != s["n_docs"]:
                    raise ValueError(f"{base}.idx does not fit the manifest")
                digest = 0
                with fs.open_input_stream(f"{base}.rec") as f:
                    step = (index["offset"] // READ_BYTES).tolist()
                    cuts = [0, *(k for k in range(1, len(step)) if step[k] != step[k - 1]), len(step)]
                    for lo, hi in zip(cuts, cuts[1:]):
                        part = index[lo:hi]
                        size = int((part["bytes"] + 16).sum())
                        data = f.read(size)
                        digest = zlib.crc32(data, digest)
                        ids = [np.frombuffer(p, f"<u{s['width']}").astype("<u4") for p in unframe(data)]
                        raw = [x.tobytes() for x in ids]
                        cols = [pa.array([int(d) if ok else None for d, ok in zip(part["doc_id"], part["has_id"])],
                                         pa.int64()),
                                pa.array(part["start"] + s["before"]), pa.array([len(x) for x in ids], pa.int64()),
                                pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if keep_ids:
                            cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
                        yield pa.RecordBatch.from_arrays(cols, names=names)
                if f"{digest:08x}" != s["digest"]:
                    raise ValueError(f"{base}.rec does not fit the manifest")

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
                             + (", ids binary" if keep_ids else ""))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes ``docs`` to a new run folder and reads the records back."""
    spark = docs.sparkSession
    folder = run_folder(spark, "records")
    write_records(docs, folder, **options)
    return read_records(spark, folder)
