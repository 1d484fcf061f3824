"""WARC archives as seekable Zstandard bundles (operator 7).

Records are grouped into frames of about FRAME bytes that decompress on their own; a bundle of
frames ends with a seek table in a skippable frame (each frame's two sizes and a checksum). An index
maps every record identifier to bundle, frame and offset inside the frame, so one record costs
one frame. A payload is stored once: the row with the smallest page_id is its response record, all
other rows of at least min_bytes are revisit records that name it.

Bundles are rows of a table in the shared folder, so any file system Spark knows can hold them.

Defined cases: a null html is an empty payload, a null url gives the record's own identifier as target.
A row with a null page_id is a response and nothing refers to it. Rows that repeat the smallest
page_id are responses too. An empty table gives no bundles. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import salted_join, stage, table

FRAME, BUNDLE, LEVEL = 1 << 17, 1 << 23, 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Date of every record: the pages carry none.
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "none" else int(inner)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, response_id: int | None) -> bytes:
    """One WARC/1.1 record; response_id names the response that a revisit refers to."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or record_id(page_id)[1:-1])
    revisit = response_id is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(response_id)}"]
    block = http if revisit else http + payload
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes, offset: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """WARC headers, HTTP headers, payload in the record, and where the next record starts."""
    end = data.index(b"\r\n\r\n", offset)
    lines = data[offset:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    cut = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])
    return head, http, block[cut + 4 :], end + 8 + size


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, level: int = LEVEL, frame: int = FRAME):
        self.pack, self.frame = zstandard.ZstdCompressor(level=level), frame
        self.out, self.sizes, self.held, self.length, self.bytes = [], [], [], 0, 0
        self.index: list[tuple[str, int, int]] = []

    def add(self, identifier: str, record: bytes) -> None:
        self.index.append((identifier, len(self.sizes), self.length))
        self.held.append(record)
        self.length += len(record)
        self.bytes += len(record)
        if self.length >= self.frame:
            self._close()

    def _close(self) -> None:
        data = b"".join(self.held)
        packed = self.pack.compress(data)
        self.out.append(packed)
        self.sizes.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.length = [], 0

    def finish(self) -> bytes:
        if self.held:
            self._close()
        table = b"".join(struct.pack("<III", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        return b"".join(self.out) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int, int]]:
    """(start, compressed size, size, checksum) of each frame."""
    frames, flags, magic = struct.unpack("<IBI", bundle[-9:])
    width = 12 if flags & CHECKSUM_FLAG else 8
    begin = len(bundle) - 9 - frames * width
    if magic != SEEKABLE_MAGIC or struct.unpack("<II", bundle[begin - 8 : begin]) != (SKIPPABLE_MAGIC, frames * width + 9):
        raise ValueError("no seek table")
    out, at = [], 0
    for k in range(frames):
        packed, size = struct.unpack_from("<II", bundle, begin + k * width)
        out.append((at, packed, size, struct.unpack_from("<I", bundle, begin + k * width + 8)[0] if width == 12 else -1))
        at += packed
    if at != begin - 8:
        raise ValueError("the seek table does not match the frames")
    return out


def read_frame(bundle: bytes, entry: tuple[int, int, int, int]) -> bytes:
    start, packed, size, checksum = entry
    data = zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=size)
    if len(data) != size or checksum >= 0 and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
        raise ValueError("a frame is damaged")
    return data


def read_record(bundle: bytes, frame: int, offset: int):
    """One record by its place: reads the seek table and one frame."""
    return parse_record(read_frame(bundle, seek_table(bundle)[frame]), offset)


_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())]))
_BUNDLES = pa.schema([("bundle", pa.string()), ("archive", pa.binary()), ("index", _INDEX)])


def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    bundle = BundleWriter()

    def row():
        index = [{"record_id": i, "frame": f, "offset": o} for i, f, o in bundle.index]
        return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([bundle.finish()], pa.binary()), pa.array([index], _INDEX)], schema=_BUNDLES)

    for batch in batches:
        for k in range(batch.num_rows):  # one at a time: a batch may hold long pages
            page, url, html, response = (batch.column(c)[k].as_py() for c in ("page_id", "url", "html", "response_id"))
            bundle.add(record_id(page), build_record(page, url, (html or "").encode("utf-8", "surrogatepass"), response))
            if bundle.bytes >= BUNDLE:
                yield row()
                bundle, n = BundleWriter(), n + 1
    if bundle.index:
        yield row()


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64())])
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_offset long"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            name, archive = batch.column("bundle")[k].as_py(), batch.column("archive")[k].as_py()
            frames, rows, now, data = seek_table(archive), [], -1, b""
            for entry in batch.column("index")[k].as_py():
                if entry["frame"] != now:
                    now, data = entry["frame"], read_frame(archive, frames[entry["frame"]])
                head, http, payload, _ = parse_record(data, entry["offset"])
                digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
                if head["WARC-Record-ID"] != entry["record_id"] or not revisit and payload_digest(payload) != digest:
                    raise ValueError(f"{entry['record_id']} does not read back")
                rows.append((_page_of(entry["record_id"]), int(http["Content-Length"]) if revisit else len(payload), digest, head["WARC-Type"], _page_of(head["WARC-Refers-To"]) if revisit else None, name, now, entry["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def write_bundles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of pages (page_id, url, html) as a staged table (bundle, archive, index)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    hashed = stage(pages.where("page_id is not null").where(size >= min_bytes).select("page_id", sha.alias("sha"), size.alias("size")), "op7-hashed")
    first = stage(hashed.groupBy("sha", "size").agg(F.min("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1"), "op7-first")
    # Only rows that revisit another one: the pages themselves are shuffled only if these are many.
    again = stage(salted_join(hashed, first, ["sha", "size"], "page_id", "n").where("page_id <> response_id").select("page_id", "sha", "response_id").distinct(), "op7-again")
    marked = pages.withColumn("sha", sha).join(again, ["page_id", "sha"], "left").select("page_id", "url", "html", "response_id")
    return stage(marked.mapInArrow(_writer, "bundle string, archive binary, index array<struct<record_id:string,frame:int,offset:bigint>>"), "op7-bundles", "none")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the archives, read through the seek tables and verified."""
    return bundles.mapInArrow(_reader, READ_SCHEMA)


def op7_warc_seekable_bundles(spark, sf_dir: str) -> DataFrame:
    """The records as read back through the index; where each stands (bundle, frame, frame_offset) is in read_bundles()."""
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in SQL. Five hexadecimal digits are four of the digest's letters.
OP7_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), h AS (SELECT page_id, body, strlen(body)::BIGINT AS size, upper(sha1(body)) AS sha FROM p),
f AS (SELECT sha, size, min(page_id) AS first FROM h WHERE page_id IS NOT NULL GROUP BY 1, 2)
SELECT page_id, h.size AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h.sha, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h LEFT JOIN f ON f.sha = h.sha AND f.size = h.size"""
