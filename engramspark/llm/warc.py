"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle (one file) ends with a footer, the
seek table of the Zstandard seekable format (a skippable frame), so a reader finds any frame from the last
bytes of the file.  The manifest maps each record's identifier to its bundle, frame and the offset inside
the frame.

Files are written by the tasks that hold the records, into the shared folder, through the file system of
its URI.  A file's name carries its task attempt and only the files of attempts that Spark accepted are in
the manifest, so a lost executor or a repeated task leaves at most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, new_path

FRAME_BYTES, BUNDLE_BYTES, REVISIT_FROM = 1 << 20, 1 << 28, 1000
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_SALTS = 32


# Bundles


class BundleWriter:
    """Appends records to frames; ``add`` returns (frame, frame offset, offset in frame)."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.parts: list[bytes] = []
        self.size = self.offset = 0
        self.table: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.size and self.size + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.table), self.offset, self.size
        self.parts.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        if self.size:
            frame = self.zstd.compress(b"".join(self.parts))
            self.sink.write(frame)
            self.table.append((len(frame), self.size))
            self.offset += len(frame)
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.sink.close()


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer of a bundle."""
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - n * width)
    body, out, at = source.read(n * width), [], 0
    for k in range(n):
        c, d = struct.unpack_from("<II", body, k * width)
        out.append((at, c, d))
        at += c
    return out


def _open(uri: str, write: bool = False):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
    if write:
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(path, compression=None)
    return fs.open_input_file(path)


# Records


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}"


def _line(value: str) -> str:
    """A header value on one line: controls and line ends as percent escapes."""
    return "".join(c if c.isprintable() else "".join(f"%{x:02X}" for x in c.encode("utf-8", "replace")) for c in value)


def to_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, kind: str, refers_to: int | None) -> bytes:
    """``size`` and ``digest`` are those of the full payload, which a revisit does not hold."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, url, digest)}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[dict]:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (None in a revisit), offset."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        first, *lines = frame[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        block = frame[end + 4 : end + 4 + int(head["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
        number = lambda k: int(head[k]) if k in head else None
        yield {"record_id": head["WARC-Record-ID"][1:-1], "page_id": number("X-Page-Id"), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload_digest": digest, "payload_bytes": size, "payload": None if revisit else payload, "offset": at}
        at = end + 4 + len(block) + 4


# DataFrames


def records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to of each row of ``pages`` (page_id, url, html).

    Payloads are equal when length and SHA-256 are.  A null id never is the one referred to; where no row of
    a group has an id, all are responses.  Rows that share the largest id are all responses.  The groups are
    joined back salted, so that a page that a third of all rows repeat is joined in many tasks.
    """
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    src = src.withColumns({"key": F.sha2("payload", 256), "payload_digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long"), "salt": F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")})
    salted = src.filter(F.col("n") >= revisit_from).groupBy("key", "n", "salt").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("many"))
    groups = salted.groupBy("key", "n").agg(F.max("last").alias("last"), F.sum("many").alias("many"), F.expr("bit_or(shiftleft(1L, salt))").alias("mask")).filter("many > 1 AND last IS NOT NULL")
    one = F.lit(1).cast("long")
    groups = groups.select(F.col("key").alias("g_key"), F.col("n").alias("g_n"), "last", F.explode(F.filter(F.sequence(F.lit(0), F.lit(_SALTS - 1)), lambda i: F.col("mask").bitwiseAND(F.call_function("shiftleft", one, i)) != 0)).alias("g_salt"))
    out = src.join(groups, (F.col("key") == F.col("g_key")) & (F.col("n") == F.col("g_n")) & (F.col("salt") == F.col("g_salt")), "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.select("page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "payload_digest", F.col("n").alias("payload_bytes"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


MANIFEST = "record_id string, page_id long, bundle string, frame int, frame_offset long, offset long, length long"


def write_bundles(recs: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the rows of ``records`` as bundles below ``folder``; the manifest, materialised.

    Memory of a task: one frame, or one record that is longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer, uri, files = None, "", 0
        for b in batches:
            rows = []
            for page_id, url, payload, digest, size, kind, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.zst"
                    writer, files = BundleWriter(_open(uri, write=True), frame_bytes), files + 1
                record = to_record(page_id, url, payload, digest, size, kind, refers_to)
                frame, at, offset = writer.add(record)
                rows.append((record_id(page_id, url, digest), page_id, uri, frame, at, offset, len(record)))
                if writer.offset > bundle_bytes:
                    writer.close()
                    writer = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.strip().split(" ")[0] for x in MANIFEST.split(",")])
        if writer is not None:
            writer.close()

    return materialize(recs.mapInArrow(lean(run), MANIFEST), "warc-manifest")


READ = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_bundles(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the manifest's bundles, parsed again; payload digests are verified.

    The footer of each bundle gives its frames, which are dealt out and read on their own.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                with _open(uri) as f:
                    table = seek_table(f, f.size())
                if table:
                    at, c, d = zip(*table, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(at)), pa.array(at, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], names=["bundle", "at", "stored", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zstd = zstandard.ZstdDecompressor()
        names = [x.strip().split(" ")[0] for x in READ.split(",")][: 8 if payload else 7]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for uri, at, stored, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(uri) as f:
                    f.seek(at)
                    frame = zstd.decompress(f.read(stored), max_output_size=size)
                rows = list(parse_records(frame))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=False)], names=names)

    bundles = manifest.select("bundle").distinct().mapInArrow(lean(frames), "bundle string, at long, stored long, size long")
    parts = max(8, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return bundles.repartition(parts, "bundle", "at").mapInArrow(lean(read), READ if payload else READ.rpartition(",")[0])


def lookup(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose identifiers (record_id) are in ``ids``: their frames alone are read, at their offsets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for uri, at, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(uri) as f:
                    _, stored, size = next(x for x in seek_table(f, f.size()) if x[0] == at)
                    f.seek(at)
                    frame = zstandard.ZstdDecompressor().decompress(f.read(stored), max_output_size=size)
                r = next(parse_records(frame[offset : offset + length]))
                names = [x.strip().split(" ")[0] for x in READ.split(",")]
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names}], schema=pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]))

    return manifest.join(ids.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame_offset", "offset", "length").mapInArrow(lean(read), READ)


def archive(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write ``pages`` into bundles and return their manifest."""
    return write_bundles(records(pages), folder or new_path(pages.sparkSession, "warc"), frame_bytes, bundle_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written when the query is built, and read back when its rows are asked for."""
    manifest = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_bundles(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM d
"""
