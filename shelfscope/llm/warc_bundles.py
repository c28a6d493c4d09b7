"""WARC archives in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames of whole records, closed by a skippable frame with
a seek table, as in the public seekable format.  The index maps each record to bundle, frame and offset
inside the decompressed frame, so that one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch_path

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
_RUN_FRAMES = 32  # neighbouring frames that one task reads with one look at the seek table
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_HTTP = b"HTTP/1.1 200 OK\r\n\r\n"
_URN = "urn:page:"
INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response, or a revisit without its payload that names digest and length."""
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Refers-To: <{_URN}{refers_to}>",
                     "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.size = self.written = 0
        self.pack = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        at = len(self.frames), self.size
        self.parts.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.parts:
            packed = self.pack.compress(b"".join(self.parts))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class BundleReader:
    """Frames of a bundle through its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != _SEEKABLE or flags:
            raise ValueError("no seek table at the end of the bundle")
        raw = file.read_at(8 * n, size - 9 - 8 * n)
        self.sizes = list(struct.iter_unpack("<II", raw))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, i: int) -> bytes:
        packed, size = self.sizes[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[i]), max_output_size=size)


def parse(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """Record at ``at`` as a row of ``RECORD``, and where the next one starts.  Digests are checked."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    stop = end + 4 + int(head["Content-Length"])
    digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
    payload = None if revisit else data[end + 4 + len(_HTTP): stop]
    if payload is not None and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")

    def number(urn: str) -> int | None:
        n = urn.strip("<>").removeprefix(_URN)
        return int(n) if n else None

    row = (number(head["WARC-Record-ID"]), int(head["WARC-Payload-Length"]), digest, head["WARC-Type"],
           number(head["WARC-Refers-To"]) if revisit else None, payload)
    return row, stop + 4


def _uri(spark: SparkSession, folder: str) -> str:
    """``folder`` on the session's default file system, as tasks on any machine must name it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    uri = store.makeQualified(path).toUri().toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def _spread(spots: DataFrame) -> DataFrame:
    """Index rows by runs of neighbouring frames, over as many tasks as the frames call for.

    The number is given to Spark, which would otherwise merge rows of a few bytes, however much they lead to.
    """
    run = F.floor(F.col("frame") / _RUN_FRAMES)
    runs = spots.select("bundle", run).distinct().count()
    frames = spots.select("bundle", "frame").distinct().count()
    tasks = max(runs, min(frames, spots.sparkSession.sparkContext.defaultParallelism), 1)
    by = [F.col("bundle"), run] if runs == tasks else [F.col("bundle"), F.col("frame")]
    return spots.repartition(tasks, *by).sortWithinPartitions("bundle", "frame")


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def write_bundles(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0,
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one record per row of ``page_id, url, html`` and return the index, itself a table in ``folder``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` the smallest page_id is the response (all
    rows of it, if it repeats) and the others revisit it.  Files are written by the tasks, below
    ``folder`` or the session's shared folder; each attempt of a task has files of its own, and the index
    only names those of the attempt that Spark committed, so a lost executor leaves at most unused files.
    A null html is an empty payload, a null page_id an empty record id that is never a revisit's target.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    uri = _uri(spark, folder)
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = rows.where(f"page_id is not null and octet_length(payload) >= {int(min_revisit_bytes)}").groupBy("digest").agg(
        F.min("page_id").alias("first"))
    rows = rows.join(first, "digest", "left").select("page_id", "url", "payload", "first")
    schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()),
                        ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        out = writer = name = None
        for batch in batches:
            index = []
            for page_id, url, payload, target in zip(*[c.to_pylist() for c in batch.columns]):
                if writer is None:
                    store.create_dir(f"{root}/bundles")
                    name = f"bundles/{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(out, frame_bytes)
                data = record(page_id, url, payload, target, target is not None and target != page_id)
                frame, offset = writer.add(data)
                index.append((page_id, name, frame, offset, len(data)))
                if writer.written + writer.size >= bundle_bytes:
                    writer.close()
                    writer = None
            yield _columns(index, schema)
        if writer is not None:
            writer.close()

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index").withColumn("folder", F.lit(uri))


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_bundles(index: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the indexed frames; payloads come along if asked for.

    A bundle is read by as many tasks as its frames call for, each through the seek table.  No index rows give none.
    """
    frames = _spread(index.select("folder", "bundle", "frame").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = bundle = last = None
        for batch in batches:
            for folder, name, frame in zip(*[c.to_pylist() for c in batch.columns]):
                if (folder, name) != last:
                    if file is not None:
                        file.close()
                    store, root = fs.FileSystem.from_uri(folder)
                    file, last = store.open_input_file(f"{root}/{name}"), (folder, name)
                    bundle = BundleReader(file)
                data, at, rows = bundle.frame(frame), 0, []
                while at < len(data):
                    row, at = parse(data, at)
                    rows.append(row if payloads else (*row[:-1], None))
                yield _columns(rows, _RECORD)
        if file is not None:
            file.close()

    return frames.mapInArrow(run, RECORD)


def read_records(index: DataFrame) -> DataFrame:
    """Only the records of the given index rows: one frame is decompressed for each frame in demand."""
    spots = _spread(index.select("folder", "bundle", "frame", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data = None, b""
        for batch in batches:
            rows = []
            for folder, name, frame, offset in zip(*[c.to_pylist() for c in batch.columns]):
                if (name, frame) != last:
                    store, root = fs.FileSystem.from_uri(folder)
                    with store.open_input_file(f"{root}/{name}") as file:
                        data, last = BundleReader(file).frame(frame), (name, frame)
                rows.append(parse(data, offset)[0])
            yield _columns(rows, _RECORD)

    return spots.mapInArrow(run, RECORD)
