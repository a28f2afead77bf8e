"""Deterministic sharded WARC writer and reader.

Writing: payload digests are grouped (partial counts, no group is gathered) to
find the response of every payload; records stand in the order of page_id, digest
and url, so equal rows are neighbours, and the order is cut into shards by exact
running sums of payload bytes, so the cuts depend on the rows alone: not on range
samples, partition settings or the layout of the input.  A task streams a shard
into gzip members, one per record, and starts a new file when the compressed size
reaches ``ROLL_BYTES``.  Headers and digests are made anew; record ids, dates and
gzip headers depend on the record alone.  So the same pages always give the same
files with the same bytes.  Rows equal in page_id and digest stay in one shard.

Committing: a task writes to a name of its own attempt and returns a manifest
row per file; the manifest is a Parquet table, so rows of lost attempts are
never in it.  A second job renames each listed file to its final name (a file
that already has it is left alone) and readers open listed files only.  Left
over temporary files are never read, and removed once all files are committed.

Files go through ``pyarrow.fs`` to the URI of the shared checkpoint folder.

Defined results: null html = empty payload; payloads of fewer than ``min_bytes``
bytes are always responses; of equal payloads the largest page_id is the
response (null counts as smallest, of rows with equal ids the first in order),
the others revisit it; null urls are written empty and read back as null; an
empty table writes no file and gives no rows; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closurelens.llm.common import shared_dir
from closurelens.operators import ranks

ROLL_BYTES = 64 << 20
MIN_BYTES = 0
#: payload bytes of a shard at most (beyond one row's), and shards of a smaller table
SHARD_BYTES, SHARDS = 256 << 20, 64
#: bytes counted for the headers of a record
HEAD_BYTES = 512
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "tmp string, path string, n_records long, n_bytes long, sha256 string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)


def _open_fs(folder: str) -> tuple[pafs.FileSystem, str]:
    uri = _uri(folder)
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{sha1}')}>"


def record(page_id: int | None, url: str | None, block: bytes, n: int, sha1: str, revisits: tuple | None) -> bytes:
    """One WARC record of a payload of n bytes; ``revisits`` holds the response's
    page_id for revisits, whose block is empty."""
    head = ["WARC/1.1", "WARC-Type: " + ("revisit" if revisits else "response"),
            "WARC-Record-ID: " + record_id(page_id, sha1), "WARC-Date: " + DATE,
            "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
            "WARC-Payload-Digest: sha1:" + sha1, "WARC-Block-Digest: sha1:" + digest(block),
            "X-Page-Id: " + ("" if page_id is None else str(page_id)), f"X-Payload-Length: {n}"]
    if revisits:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 "WARC-Refers-To: " + record_id(revisits[0], sha1),
                 "X-Refers-To-Page-Id: " + ("" if revisits[0] is None else str(revisits[0]))]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time stamp."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_PREPARED = ("page_id", "url", "sha1", "length", "data", "best", "shard")


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed response records, so that the shuffles carry gzip members
    instead of pages."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            sha1, length, data = [], [], []
            for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = html.encode()
                sha1.append(hashlib.sha1(payload).digest())
                length.append(len(payload))
                data.append(member(record(page_id, url, payload, len(payload), digest(payload), None)))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(sha1, pa.binary()),
                 pa.array(length, pa.int64()), pa.array(data, pa.binary())], list(_PREPARED[:-2]))


def _writer(folder: str, roll: int, min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = _open_fs(folder)
        attempt = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, n, rows, seq, sha, tmp = None, 0, [], 0, None, ""
        last: tuple | None = None
        here: int | None = None

        def close() -> None:
            nonlocal out, seq
            if out is not None:
                out.close()
                rows.append((tmp, f"{root}/warc/part-{here:06d}-{seq:05d}.warc.gz", n, size, sha.hexdigest()))
                out, seq = None, seq + 1

        size = 0
        for b in batches:
            for page_id, url, sha1, length, data, best, shard in zip(*(b.column(c).to_pylist() for c in _PREPARED)):
                if shard != here:
                    close()
                    here, seq = shard, 0
                first = (page_id, sha1) != last
                last = (page_id, sha1)
                if length >= min_bytes and not (page_id == best and first):
                    name = base64.b32encode(sha1).decode()
                    data = member(record(page_id, url, b"", length, name, (best,)))
                if out is None:
                    tmp = f"{root}/tmp/{attempt}-{shard:06d}-{seq:05d}"
                    fs.create_dir(f"{root}/tmp", recursive=True)
                    out, n, size, sha = fs.open_output_stream(tmp, compression=None), 0, 0, hashlib.sha256()
                out.write(data)
                sha.update(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    close()
        close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("tmp", "path", "n_records", "n_bytes", "sha256"), r)) for r in rows],
                                             schema=pa.schema([("tmp", pa.string()), ("path", pa.string()), ("n_records", pa.int64()),
                                                               ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    return run


def _commit(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open_fs(folder)
        for pdf in batches:
            for tmp, path in zip(pdf.tmp, pdf.path):
                fs.create_dir(f"{root}/warc", recursive=True)
                if fs.get_file_info(path).type == pafs.FileType.NotFound:
                    fs.move(tmp, path)
            yield pdf

    return run


def _plan(rows: DataFrame) -> tuple[DataFrame, int]:
    """(page_id, sha1, best, shard) of every pair of page_id and digest, and the number of shards."""
    keys = rows.groupBy("page_id", F.unhex(F.sha1("html")).alias("sha1")).agg(F.sum(F.octet_length("html") + HEAD_BYTES).alias("bytes"))
    order = [F.asc_nulls_first("page_id"), F.asc("sha1")]
    placed = ranks.running_sums(ranks.shards(keys, [], order, "warc-order"), [], order, {"upto": F.col("bytes")})
    total = placed.agg(F.max("upto")).first()[0] or 0
    size = min(SHARD_BYTES, -(-total // SHARDS)) or 1
    best = keys.groupBy("sha1").agg(F.max("page_id").alias("best"))
    plan = placed.withColumn("shard", F.floor((F.col("upto") - F.col("bytes")) / size).cast("int")).join(best, "sha1")
    return plan.select(F.col("page_id").alias("at_id"), F.col("sha1").alias("at_sha1"), "best", "shard"), -(-total // size)


def write(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives under the folder and returns the committed manifest
    (tmp, path, n_records, n_bytes, sha256)."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).alias("html"))
    plan, shards = _plan(rows)
    prepared = rows.mapInArrow(_prepare, "page_id long, url string, sha1 binary, length long, data binary")
    named = prepared.join(plan, prepared.page_id.eqNullSafe(F.col("at_id")) & (prepared.sha1 == F.col("at_sha1")))
    parts = max(1, min(shards, max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    ordered = named.repartition(parts, "shard").sortWithinPartitions("shard", "page_id", "sha1", "url")
    manifest = os.path.join(folder, "manifest")
    ordered.select(*_PREPARED).mapInArrow(_writer(folder, roll, min_bytes), _MANIFEST) \
        .write.mode("error").parquet(manifest + "-staged")
    staged = spark.read.schema(_MANIFEST).parquet(manifest + "-staged")
    staged.repartition(parts, "path").mapInPandas(_commit(folder), _MANIFEST).write.mode("error").parquet(manifest)
    fs, root = _open_fs(folder)
    if fs.get_file_info(f"{root}/tmp").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/tmp")
    return spark.read.schema(_MANIFEST).parquet(manifest)


def read_records(stream, path: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every gzip member of one archive, read in pieces."""
    z, buffer, pending = zlib.decompressobj(31), bytearray(), b""
    while True:
        data = pending or stream.read(1 << 20)
        if not data:
            break
        buffer += z.decompress(data)
        pending = z.unused_data
        if z.eof:
            z = zlib.decompressobj(31)
            head, _, rest = bytes(buffer).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            block = rest[:-4]
            if len(block) != int(headers["Content-Length"]) or headers["WARC-Block-Digest"] != "sha1:" + digest(block):
                raise ValueError(f"damaged record in {path}: {headers.get('WARC-Record-ID')}")
            yield headers, block
            buffer.clear()
    if buffer:
        raise ValueError(f"{path} ends within a record")


def _reader(folder: str):
    names = [f.split()[0] for f in _RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open_fs(folder)
        kinds = pa.schema([(n, pa.string() if n in ("url", "payload_digest", "record_type") else pa.int64()) for n in names])

        def number(x: str | None) -> int | None:
            return int(x) if x else None

        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for h, block in read_records(stream, path):
                        kind, sha1 = h["WARC-Type"], h["WARC-Payload-Digest"][5:]
                        if kind == "response" and (digest(block) != sha1 or len(block) != int(h["X-Payload-Length"])):
                            raise ValueError(f"payload digest differs in {path}")
                        rows.append((number(h["X-Page-Id"]), h["WARC-Target-URI"] or None, int(h["X-Payload-Length"]), sha1,
                                     kind, number(h.get("X-Refers-To-Page-Id")) if kind == "revisit" else None))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)

    return run


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the listed archives."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(_reader(folder), _RECORD)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all pages to a new folder and reads the archives back: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(pages, folder, min_bytes=min_bytes), folder).drop("url")


def oracle() -> str:
    """The same rows from SQL: SHA-1 in base 32 from five hex digits (20 bits) at a time."""
    return """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda j: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(p.h, 5 * j + 1, 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN b USING (h)"""
