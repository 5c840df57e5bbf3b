"""WARC archives as seekable Zstandard bundles.

Each page becomes a WARC record: a response with its payload, or a revisit that refers to the response with the same
payload. A task writes its records to bundle files in the shared folder: groups of records are independent Zstandard
frames, and a skippable frame at the end holds the seek table (compressed and decompressed size of each frame), so
ordinary Zstandard tools read a bundle from the start and this module reads any record alone. The index maps record
identifiers to (bundle, frame, offset inside the decompressed frame, length).

A bundle's name carries the attempt that wrote it and the index names only bundles of finished tasks, so a lost
executor or a second attempt leaves at most unread files.

Defined cases: null html is an empty payload; payloads under the least size are all responses; equal payloads with the
same smallest page_id twice are both responses; a record over FRAME_BYTES is a frame of its own; null url is written empty;
other columns are ignored; an empty table writes nothing and gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.common import attach, mapped, shared_root, staged, table

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
#: Payloads of fewer bytes are never revisits.
LEAST_SHARED = 100
#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table's footer.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"


def _file_system(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        root = root if "://" in root else "file://" + root.removeprefix("file:")
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record(page_id: int, url: str, kind: str, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {(url or '').translate({13: None, 10: None})}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Appends records to one bundle file."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.zstd = stream, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset) at which the record will be found."""
        if self.held and self.held + len(data) > FRAME_BYTES:
            self._frame()
        at = len(self.frames), self.held
        self.parts.append(data)
        self.held += len(data)
        return at

    def _frame(self):
        packed = self.zstd.compress(b"".join(self.parts))
        self.stream.write(packed)
        self.frames.append((len(packed), self.held))
        self.written += len(packed)
        self.parts.clear()
        self.held = 0

    def close(self):
        if self.held:
            self._frame()
        table_ = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(table_)) + table_)
        self.stream.close()


class BundleReader:
    """Reads frames of a bundle by its seek table; keeps the last one."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.zstd = stream, zstandard.ZstdDecompressor()
        size = stream.size()
        stream.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", stream.read(9))
        if magic != _SEEKABLE:
            raise ValueError("not a seekable bundle")
        stream.seek(size - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", stream.read(8 * n)))
        self.places, at = [], 0
        for packed, plain in sizes:
            self.places.append((at, packed, plain))
            at += packed
        self.last: tuple[int, bytes] = -1, b""

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            at, packed, plain = self.places[frame]
            self.stream.seek(at)
            self.last = frame, self.zstd.decompress(self.stream.read(packed), max_output_size=plain)
        return self.last[1][offset : offset + length]


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, html, digest, bytes, first: the response that holds the payload (null where none is shared)."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "bytes": F.octet_length("html").cast("long")})
    known = staged(rows.select("page_id", "digest", "bytes"), "warc-digests")
    shared = known.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return attach(rows, staged(shared, "warc-shared"), ["digest"], "n", known.count())


def write_bundles(records: DataFrame, root: str) -> DataFrame:
    """Write the rows of plan_records; returns the index: record_id, page_id, bundle, frame, offset, length."""

    def run(batches):
        fs, base = _file_system(root)
        task = TaskContext.get()
        writer, name, serial, rows = None, "", 0, []

        def done():
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["record_id", "page_id", "bundle", "frame", "offset", "length"])

        for b in batches:
            for low in range(0, b.num_rows, 200):
                for page, url, html, digest, size, first in zip(*(c.to_pylist() for c in b.slice(low, 200).columns), strict=True):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        name = f"part-{task.partitionId():06d}-{serial:04d}-{task.taskAttemptId()}.warc.zst"
                        writer, serial = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None)), serial + 1
                    kind = "revisit" if first is not None and first != page else "response"
                    data = record(page, url, kind, digest, size, html.encode(), first)
                    rows.append((record_id(page), page, name, *writer.add(data), len(data)))
                    if writer.written > BUNDLE_BYTES:
                        writer.close()
                        writer = None
            if rows and writer is None:
                yield done()
                rows.clear()
        if writer is not None:
            writer.close()
        if rows:
            yield done()

    cols = records.select("page_id", "url", "html", "digest", "bytes", "first")
    return staged(mapped(cols, run, "record_id string, page_id long, bundle string, frame long, offset long, length long"), "warc-index")


def read_records(index: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """Read the index's records from their bundles: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""

    def run(batches):
        fs, base = _file_system(root)
        reader, name = None, None
        for b in batches:
            rows = []
            for bundle, frame, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bundle != name:
                    if reader is not None:
                        reader.stream.close()
                    reader, name = BundleReader(fs.open_input_file(f"{base}/{bundle}")), bundle
                head, payload = parse(reader.read(frame, offset, length))
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response":
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"]):
                        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                rows.append((int(head["X-Page-Id"]) if head["X-Page-Id"] else None, int(head["X-Payload-Length"]), digest, kind, int(head["X-Refers-To-Page"]) if kind == "revisit" else None, head["WARC-Target-URI"], payload if with_payload else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    # the records of a bundle are read by one task, frame by frame; a bundle is at most BUNDLE_BYTES and a frame
    rows = index.select("bundle", "frame", "offset", "length").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return mapped(rows, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op7_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to bundles and read back."""
    root = f"{shared_root(spark)}/warc-{uuid.uuid4().hex}"
    index = write_bundles(plan_records(table(spark, sf_dir, "pages")), root)
    return read_records(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM r
"""
