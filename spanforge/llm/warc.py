"""WARC (13): bundles of records in seekable Zstandard files.

A task writes its rows as WARC records into bundles. Records are gathered into frames of some
``FRAME_BYTES``, each compressed on its own; a footer in a skippable frame (the seek table)
has every frame's compressed and raw size, so that a reader finds any frame from the end of
the file, and ordinary Zstandard readers see one stream. The index maps a record's identifier
to bundle, frame and offset in the raw frame; one record costs one frame to read.

Rows with equal payloads become one response and revisits that refer to it. Payloads are
compared by SHA-256; groups of two and more are found on narrow rows by partial counts, so
that copies of one payload never meet in a task with their texts.

Bundles are written to the shared folder through pyarrow's file systems under a name that no
other attempt uses; only bundles named by the stored index count, so a lost executor leaves at
most a file that nothing reads.

Edge cases: a null text is the empty payload; a null url has no Target-URI line, and control
characters and blanks in one are percent-encoded; a null page id is larger than any other and
``refers_to`` is null where it is the response's; of rows that repeat id, url and text one is
the response and the others revisit it; a payload longer than a frame is a frame of its own;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
#: Copies of one row that are written by one task; raw bytes that a reading task gets.
COPIES, TASK_BYTES = 1000, 1 << 27
# Numbers of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The records' date: rows have none, and the same rows should give the same bytes.
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records --------------------------------------------------------------------------------
def record_bytes(kind: str, name: str, url: str | None, payload: bytes, sha: str, refers_to: str | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Fields of the record at ``at`` (names in lower case), its block, and where the next begins."""
    end = raw.index(b"\r\n\r\n", at)
    version, *lines = raw[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    start = end + 4
    stop = start + int(fields["content-length"])
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end at {stop}")
    return fields, raw[start:stop], stop + 4


def payload_of(fields: dict, block: bytes) -> tuple[int, bytes | None]:
    """Size of the full payload, and the payload itself where the record holds it (checked)."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
    if fields["warc-type"] == "revisit":
        return size, None
    if len(payload) != size or "sha1:" + digest(payload) != fields["warc-payload-digest"]:
        raise ValueError(f"{fields['warc-record-id']}: the payload is not what its digest says")
    return size, payload


# ---- bundles --------------------------------------------------------------------------------
class Bundle:
    """A seekable file being written: add() records, close() writes the last frame and the footer."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.out, self.frame_bytes = uri, fs.open_output_stream(path, compression=None), frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.raw, self.frames, self.size = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Number of the record's frame and its offset there."""
        if self.raw and len(self.raw) + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.frames), len(self.raw)
        self.raw += record
        return at

    def flush(self) -> None:
        if self.raw:
            frame = self.pack.compress(bytes(self.raw))
            self.out.write(frame)
            self.frames.append((len(frame), len(self.raw)))
            self.size += len(frame)
            self.raw = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Frames:
    """Frames of a bundle, by its seek table."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self.file.read_at(n * width, size - 9 - n * width)
        self.sizes = [struct.unpack_from("<II", table, k * width) for k in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def read(self, k: int) -> bytes:
        packed, raw = self.sizes[k]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[k]), max_output_size=raw)
        if len(data) != raw:
            raise ValueError(f"frame {k} has {len(data)} bytes, not {raw}")
        return data


def _opened(kept: dict, uri: str) -> Frames:
    if uri not in kept:
        kept.clear()
        kept[uri] = Frames(uri)
    return kept[uri]


# ---- jobs -----------------------------------------------------------------------------------
def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, url, payload, first_id, grouped, is_first, copy): whether a row's payload of at least
    ``least_bytes`` is shared, by which smallest id, and whether this row is the one to keep it."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256))).withColumn("u", F.xxhash64("url"))
    key = ["id", "u", "sha"]
    narrow = materialize(rows.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.length("payload")).alias("size")), "payloads")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "u"))
    groups = narrow.where(F.col("size") >= least_bytes).groupBy("sha").agg(first.alias("f"), F.sum("n").alias("n")).where("n > 1")
    groups = small(materialize(groups.select("sha", F.col("f.id").alias("first_id"), F.col("f.u").alias("first_u")), "shared"))
    again = narrow.where("n > 1")
    rows = rows.withColumn("copy", F.lit(0))
    if again.take(1):  # rows that repeat altogether: written from one of them, as often as they were counted
        again = small(materialize(again.select(*(F.col(c).alias("_" + c) for c in key), "n"), "again"))
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("u") == F.col("_u")) & (F.col("sha") == F.col("_sha"))
        once = rows.join(again.drop("n"), same, "left_semi").groupBy(*key).agg(F.min(F.struct("url", "payload")).alias("r")).select(*key, "r.*").join(again, same)
        more = once.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition(*key, "part")
        more = more.withColumn("copy", F.explode(F.expr(f"sequence(part * {COPIES}, least(n, (part + 1) * {COPIES}) - 1)"))).withColumn("copy", F.col("copy").cast("int"))
        rows = rows.join(again.drop("n"), same, "left_anti").unionByName(more.select(*rows.columns))
    out = rows.join(groups, "sha", "left")
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("u") == F.col("first_u")) & (F.col("copy") == 0)
    return out.select("id", "url", "u", "payload", "first_id", F.col("first_u").isNotNull().alias("grouped"), is_first.alias("is_first"), "copy")


INDEX = "id long, record_id string, path string, frame int, offset int, length int"


def write(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, **columns) -> DataFrame:
    """Writes a record per row and returns the stored index: a row per record, with the bundle's
    path, the frame's number and the record's offset and length in the raw frame."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        stem = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        bundle, n = None, 0
        for b in batches:
            rows = []
            for i, url, u, payload, first_id, grouped, is_first, copy in zip(*(c.to_pylist() for c in b.columns)):
                if bundle is None:
                    bundle, n = Bundle(f"{stem}-{n}.warc.zst", frame_bytes), n + 1
                sha = digest(payload)
                name, kind = f"urn:page:{i}:{sha}:{u % 2**64:016x}:{copy}", "response"
                if grouped and is_first:
                    name = f"urn:page:{i}:{sha}"
                elif grouped:
                    kind = "revisit"
                record = record_bytes(kind, name, url, payload, sha, f"urn:page:{first_id}:{sha}")
                rows.append((i, name, bundle.uri, *bundle.add(record), len(record)))
                if bundle.size >= bundle_bytes:
                    bundle.close()
                    bundle = None
            names = ["id", "record_id", "path", "frame", "offset", "length"]
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)
        if bundle is not None:
            bundle.close()

    return materialize(with_roles(pages, **columns).mapInArrow(run, INDEX), "index")


def _tasks(index: DataFrame) -> int:
    """Reading tasks by the bytes to read: names of frames are so narrow that their own size tells nothing."""
    size = index.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    return max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _page(name: str | None) -> int | None:
    word = name.strip("<>").split(":")[2] if name else "None"
    return None if word == "None" else int(word)


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the index's bundles, read back frame by frame: (page_id, record_id, url,
    record_type, payload_bytes, payload_digest, refers_to, payload); payloads of responses are
    held against their digests."""

    def frames(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                n = len(Frames(uri).sizes)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(range(n), pa.int32())], names=["path", "frame"])

    def records(batches):
        kept: dict[str, Frames] = {}
        names = ["page_id", "record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for uri, k in zip(*(c.to_pylist() for c in b.columns)):
                raw, at, rows = _opened(kept, uri).read(k), 0, []
                while at < len(raw):
                    f, block, at = parse_record(raw, at)
                    size, payload = payload_of(f, block)
                    name = f["warc-record-id"]
                    rows.append((_page(name), name.strip("<>"), f.get("warc-target-uri"), f["warc-type"], size, f["warc-payload-digest"].removeprefix("sha1:"), _page(f.get("warc-refers-to")), payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    paths = index.select("path").distinct()
    todo = paths.mapInArrow(frames, "path string, frame int")
    tasks = _tasks(index)
    schema = "page_id long, record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return todo.repartition(tasks, "path", "frame").sortWithinPartitions("path", "frame").mapInArrow(records, schema)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, record): the raw bytes of the records named by ``wanted`` (record_id), one
    frame read for each frame that holds any of them."""

    def run(batches):
        kept: dict[str, Frames] = {}
        for b in batches:
            last, raw, rows = None, b"", []
            for name, uri, k, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if (uri, k) != last:
                    last, raw = (uri, k), _opened(kept, uri).read(k)
                rows.append((name, raw[offset : offset + length]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[], []], (pa.string(), pa.binary()))], names=["record_id", "record"])

    found = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").select("record_id", "path", "frame", "offset", "length")
    return found.repartition(_tasks(found), "path", "frame").sortWithinPartitions("path", "frame").mapInArrow(run, "record_id string, record binary")
