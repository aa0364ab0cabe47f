"""Deterministic sharded WARC writer and reader.

Payloads are identified by SHA-1 and length. Of pages with equal payloads of at least ``least_bytes``, the one with the
largest page_id is written as a response; the others become revisit records that refer to it and carry no payload.
Records are range-sorted by page_id, every record is its own gzip member, and a shard file rolls at ``shard_bytes`` of
compressed data. Headers (lengths, digests, record ids from the payload digest and page_id, one fixed date) are made
again from the payload, so equal input gives equal bytes. Files are written under temporary names and renamed when
whole; the manifest, a Parquet table in the run's folder, names every shard with its bytes, records and digest.

Scale: digests are one native pass; the responses per payload are a map-side combined maximum over (digest, length),
joined back on narrow rows written apart from the payloads, so the copies of one payload spread by AQE's skew split.
A revisit's payload is dropped before the sort, so a payload copied a million times is shuffled once. The range sort
is by (page_id, digest, url): a repeated page_id does not need to be one range. Memory per task: one page and one
compressed record.

Nulls and edges: a null html is an empty payload; empty and short payloads are always responses; null ids sort first,
are written without an id header and never serve as a response that others refer to if an id exists; rows that repeat
both page_id and payload: the first in sort order is the response, the rest revisit it; a null url is written as an
empty target; other columns are ignored; an empty table gives no shard.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from soilcast.llm.common import dealt_shards, file_system, run_folder, ship, written

ship(__name__)

LEAST_BYTES = 1000
SHARD_BYTES = 256 << 20
DATE = "2025-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard string, path string, records bigint, bytes bigint, digest string"
_PLAIN, _MORE = 16 << 20, 1 << 20


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{page_id}/{digest}')}>"


def _digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id, url, payload: bytes, digest: str, payload_bytes: int, refers_to=None,
                 revisit: bool = False) -> bytes:
    """One WARC/1.1 record, gzip-compressed as a member of its own. ``digest``: hex SHA-1 of the full payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
            ).encode()
    block = http + (b"" if revisit else payload)
    target = "".join(c if c.isprintable() else "%" + format(ord(c), "02X") for c in (url or "")).replace(" ", "%20")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
            ("WARC-Date", DATE), ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
            ("WARC-Block-Digest", _digest32(block)), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                 ("X-Refers-To-Page-Id", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw.encode() + block + b"\r\n\r\n") + z.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, body) of one record; the block digest and both lengths are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    n = int(warc["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n" or _digest32(block) != warc["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {warc['WARC-Record-ID']}")
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def with_roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(page_id, url, digest, n_bytes, refers_to, payload): refers_to is set, and payload null, for revisits; copies
    that share the largest page_id still carry theirs."""
    html = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"),
                     html.alias("payload"))
    first = (d.where(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes")
             .agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1"))
    first = written(first.select(F.col("digest").alias("t_digest"), F.col("n_bytes").alias("t_bytes"), "top"), "warc")
    d = d.join(first, (F.col("digest") == F.col("t_digest")) & (F.col("n_bytes") == F.col("t_bytes")), "left")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return d.select("page_id", "url", "digest", "n_bytes", F.when(other, F.col("top")).alias("refers_to"),
                    F.when(~other, F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards and the manifest below ``folder`` (shared by all executors); returns the manifest."""
    spark = pages.sparkSession
    keys = ["page_id", "digest", "url"]
    src = (with_roles(pages, id_col, url_col, html_col, least_bytes).repartitionByRange(*keys)
           .sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    shards = f"{folder}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(shards)
        fs.create_dir(base, recursive=True)
        attempt, rows = uuid.uuid4().hex, []
        out = name = None
        roll = size = count = 0
        digest = None
        last = None  # (page_id, digest) of the latest response: rows that repeat it are revisits of it

        def close():
            out.close()
            fs.move(f"{base}/_temporary-{attempt}-{name}", f"{base}/{name}")
            rows.append({"shard": name, "path": f"{shards}/{name}", "records": count, "bytes": size,
                         "digest": digest.hexdigest()})

        for b in batches:
            for i in range(b.num_rows):
                page, url, sha, n, refers, payload, part = (b.column(c)[i].as_py() for c in (
                    "page_id", "url", "digest", "n_bytes", "refers_to", "payload", "part"))
                if refers is None and n >= least_bytes and page is not None and last == (page, sha):
                    refers = page
                revisit = refers is not None
                if not revisit:
                    last = (page, sha)
                rec = build_record(page, url, payload or b"", sha, n, refers, revisit)
                if out is not None and size + len(rec) > shard_bytes:
                    close()
                    out, roll = None, roll + 1
                if out is None:
                    name = f"part-{part:06d}-{roll:04d}.warc.gz"
                    out = fs.open_output_stream(f"{base}/_temporary-{attempt}-{name}", compression=None)
                    size, count, digest = 0, 0, hashlib.sha1()
                out.write(rec)
                digest.update(rec)
                size += len(rec)
                count += 1
        if out is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("shard", pa.string()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()),
                ("digest", pa.string())]))

    src.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream, one at a time."""
    data, z, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(_MORE)
            if not data:
                break
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        elif not data:
            continue
    if parts and any(parts):
        raise ValueError("truncated archive")


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record, from the
    archives named by the manifest; payload digests of responses are verified."""
    shards = dealt_shards(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds += [("payload", pa.binary())] if keep_payload else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                fs, path = file_system(s["path"])
                rows, held, count = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        warc, http, body = parse_record(data)
                        sha = base64.b32decode(warc["WARC-Payload-Digest"][5:]).hex()
                        if warc["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != sha:
                            raise ValueError(f"damaged payload in {path}")
                        page, refers = warc.get("X-Page-Id"), warc.get("X-Refers-To-Page-Id")
                        row = [None if page is None else int(page), warc["WARC-Target-URI"],
                               int(http["Content-Length"]), sha, warc["WARC-Type"],
                               None if refers is None else int(refers)]
                        rows.append(row + [body if warc["WARC-Type"] == "response" else None] if keep_payload else row)
                        count += 1
                        held += len(body) if keep_payload else 100
                        if held > _PLAIN:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)],
                                                             names=[n for n, _ in kinds])
                            rows, held = [], 0
                if count != s["records"]:
                    raise ValueError(f"{path} does not fit the manifest")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)],
                                                     names=[n for n, _ in kinds])

    schema = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
              "refers_to bigint" + (", payload binary" if keep_payload else ""))
    return shards.mapInArrow(run, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to a new run folder and reads the archives back."""
    spark = pages.sparkSession
    folder = run_folder(spark, "warc")
    write_archives(pages, folder, **options)
    return read_archives(spark, folder)
