"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding a group of whole WARC records. After
them come two skippable frames: an index (record id -> frame, offset in the frame, length) and, as
the footer, the seek table of the public seekable format (sizes of every frame, frame count, magic).
A plain Zstandard reader decompresses a bundle to an ordinary WARC file; a seeking one opens any record
by reading the footer, the index and one frame.

Records with equal payloads are written once, as the response of the smallest page id; others become
revisit records that refer to it. Null html counts as empty. Rows that repeat both id and payload
are all responses; of equal payloads with ids and without, the null ids revisit. Payloads smaller than
``min_revisit_bytes`` are always responses. An empty table gives no bundle and no row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.llm.common import open_output
from pixelweft.runtime import discard, make_folder, materialize

SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
INDEX_ROW = struct.Struct("<qIII")
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    tail = name.strip("<>").rsplit(":", 1)[1]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, HTTP head and payload of each record in decompressed bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        cut = block.index(b"\r\n\r\n") + 4
        yield fields, block[:cut], block[cut:]
        at = end + 4 + size + 4


class BundleWriter:
    """Collects records into frames; ``finish`` gives the bundle's bytes."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frame_bytes, self.frames, self.index = frame_bytes, [], []
        self.group, self.group_size, self.size = [], 0, 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append((NO_ID if page_id is None else page_id, len(self.frames), self.group_size, len(data)))
        self.group.append(data)
        self.group_size += len(data)
        if self.group_size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.group:
            packed = self.compress(b"".join(self.group))
            self.frames.append((packed, self.group_size))
            self.size += len(packed)
            self.group, self.group_size = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        rows = self.compress(b"".join(INDEX_ROW.pack(*r) for r in sorted(self.index)))
        index = struct.pack("<II", SKIPPABLE_INDEX, len(rows)) + rows
        table = [(len(p), n) for p, n in self.frames] + [(len(index), 0)]
        seek = b"".join(struct.pack("<II", *r) for r in table) + struct.pack("<IBI", len(table), 0, SEEK_MAGIC)
        return b"".join(p for p, _ in self.frames) + index + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek


class Bundle:
    """Seeking reader of one bundle."""

    def __init__(self, data: bytes):
        import zstandard

        self.data = memoryview(data)
        self.decompress = zstandard.ZstdDecompressor().decompress
        count, _, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        table = list(struct.iter_unpack("<II", self.data[-9 - 8 * count : -9]))
        self.starts, at = [], 0
        for packed, _ in table:
            self.starts.append((at, at + packed))
            at += packed
        a, b = self.starts.pop()
        self._index = (a + 8, b)

    def frame(self, i: int) -> bytes:
        a, b = self.starts[i]
        return self.decompress(self.data[a:b])

    def index(self) -> list[tuple[int | None, int, int, int]]:
        a, b = self._index
        rows = self.decompress(self.data[a:b])
        return [(None if i == NO_ID else i, f, o, n) for i, f, o, n in INDEX_ROW.iter_unpack(rows)]

    def read(self, page_id: int | None) -> list[bytes]:
        """The records with this id: one frame is decompressed for each."""
        return [self.frame(f)[o : o + n] for i, f, o, n in self.index() if i == page_id]


def write_bundles(pages: DataFrame, out_dir: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 16 << 20, date: str = "2020-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write every row as a record; returns the record index (file, page_id, frame, frame_offset, offset, length).

    Payloads meet by digest: counts and smallest ids are aggregated before their shuffle, and the join
    that brings them to the pages is an equi-join with a written table, whose large partitions Spark can split. Rows
    are sorted in each task, so that a repeated task writes the same files again.
    """
    make_folder(pages.sparkSession, f"{out_dir}/warc")
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("uri"), body.alias("body"), F.sha1(F.encode(body, "UTF-8")).alias("digest"))
    origin = materialize(rows.groupBy("digest").agg(F.min("id").alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n"), f"{out_dir}/origins")
    rows = rows.join(origin, "digest", "left").sortWithinPartitions("id", "digest", "uri")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, bundle = TaskContext.get().partitionId(), 0, None

        def flush() -> pa.RecordBatch:
            name = f"bundle-{task:06d}-{number:05d}.warc.zst"
            stream, commit = open_output(f"{out_dir}/warc/{name}")
            stream.write(bundle.finish())
            commit()
            ids, frames, offsets, sizes = zip(*bundle.index, strict=True)
            begins, at = [], 0
            for packed, _ in bundle.frames:
                begins.append(at)
                at += len(packed)
            return pa.RecordBatch.from_pydict({"file": [name] * len(ids), "page_id": pa.array([None if i == NO_ID else i for i in ids], pa.int64()), "frame": pa.array(frames, pa.int32()), "frame_offset": pa.array([begins[f] for f in frames], pa.int64()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(sizes, pa.int64())})

        for batch in batches:
            for i, uri, text, origin in zip(*(batch[c] for c in ("id", "uri", "body", "origin")), strict=True):
                payload, i, origin = text.as_py().encode(), i.as_py(), origin.as_py()
                revisit = origin is not None and i != origin and len(payload) >= min_revisit_bytes
                bundle = bundle or BundleWriter(frame_bytes, level)
                bundle.add(i, record(i, uri.as_py(), payload, digest32(payload), origin, revisit, date))
                if bundle.size >= bundle_bytes:
                    yield flush()
                    bundle, number = None, number + 1
        if bundle:
            yield flush()

    index = rows.select("id", "uri", "body", "origin").mapInArrow(write, "file string, page_id long, frame int, frame_offset long, offset long, length long")
    index = materialize(index, f"{out_dir}/index")
    discard(pages.sparkSession, f"{out_dir}/origins")
    return index


def read_bundles(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every record of the bundles: page_id, url, payload (null for a revisit), payload_bytes,
    payload_digest, record_type, refers_to. A response whose payload doesn't match its digest raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                bundle = Bundle(content.as_buffer())
                for k in range(len(bundle.starts)):
                    out = []
                    for fields, http, payload in parse_records(bundle.frame(k)):
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                        if kind == "response" and (digest32(payload) != digest or len(payload) != size):
                            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                        to = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        out.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload.decode() if kind == "response" else None, size, digest, kind, to))
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{out_dir}/warc")
    return files.select("content").mapInArrow(read, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long")
