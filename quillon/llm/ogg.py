"""Media columns: whole texts as 8-bit samples in Ogg files (operator 4).

A payload is cut into packets of PACKET samples that alternate between two logical streams.
Packets are laced into pages of at most 255 segments, over page ends where need be; the pages of
both streams are multiplexed in order of time, each with its checksum and with the granule position
(end sample) of the last packet that ends on it. Reading verifies every checksum and page
number, reassembles the packets from their lacing values, takes the streams apart, derives every
packet's time from the granule positions, and joins the samples in order of time.

Defined cases: a null text is an empty one (one block of 192 spaces); a null id is kept; repeated rows
give repeated rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage, table

BLOCK, PACKET, RATE, STREAMS = 192, 1920, 8000, 2
#: Page flags of the container.
CONTINUED, FIRST, LAST = 1, 2, 4
_MAGIC = b"PCM8\x00\x01"
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """The container's CRC: polynomial 04C11DB7, most significant bit first, no inversions.

    It is the mirrored image of zlib's CRC of mirrored bytes, without its inversions.
    """
    c = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(serial: int, header: bytes, packets: list[bytes], ends: list[int]) -> list[tuple[int, bytes]]:
    """(start sample, page) of one logical stream; ends: end sample of each packet."""
    pages = [(-1, _page(FIRST | (0 if packets else LAST), 0, serial, 0, bytes([len(header)]), header))]
    lacing = bytearray()
    owner: list[int] = []  # packet that ends at a segment, or -1
    for k, p in enumerate(packets):
        full, rest = divmod(len(p), 255)
        lacing += b"\xff" * full + bytes([rest])
        owner += [-1] * full + [k]
    body, at, done = b"".join(packets), 0, -1
    for lo in range(0, len(lacing), 255):
        part = bytes(lacing[lo : lo + 255])
        size = sum(part)
        ended = [k for k in owner[lo : lo + 255] if k >= 0]
        start = ends[done + 1] - len(packets[done + 1])
        flags = (CONTINUED if lo and owner[lo - 1] < 0 else 0) | (LAST if lo + 255 >= len(lacing) else 0)
        pages.append((start, _page(flags, ends[ended[-1]] if ended else -1, serial, len(pages), part, body[at : at + size])))
        at += size
        done = ended[-1] if ended else done
    return pages


def encode(payload: bytes) -> bytes:
    """An Ogg file of 8-bit samples."""
    serial = zlib.crc32(payload)
    pages: list[tuple[int, int, int, bytes]] = []
    starts = range(0, len(payload), PACKET)
    for s in range(STREAMS):
        own = starts[s::STREAMS]
        packets = [payload[x : x + PACKET] for x in own]
        header = _MAGIC + struct.pack("<BBIIQ", s, STREAMS, RATE, PACKET, len(payload))
        made = stream_pages(serial ^ s, header, packets, [x + len(p) for x, p in zip(own, packets)])
        pages += [(start, s, n, page) for n, (start, page) in enumerate(made)]
    pages.sort(key=lambda p: p[:3])  # first pages first, then by time
    return b"".join(p[3] for p in pages)


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets of each logical stream with their end sample, where a page states it."""
    streams: dict[int, list[tuple[bytes, int | None]]] = {}
    state: dict[int, list] = {}  # next page number, open packet, ended
    at = 0
    while at < len(media):
        magic, version, flags, granule, serial, number, crc, segments = struct.unpack_from("<4sBBqIIIB", media, at)
        if magic != b"OggS" or version:
            raise ValueError("no page here")
        lacing = media[at + 27 : at + 27 + segments]
        begin = at + 27 + segments
        end = begin + sum(lacing)
        if end > len(media) or checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError("a page is damaged")
        if flags & FIRST:
            if serial in state:
                raise ValueError("a stream begins twice")
            state[serial], streams[serial] = [0, b"", False], []
        own = state[serial]
        if own[0] != number or own[2] or bool(flags & CONTINUED) != bool(own[1]):
            raise ValueError("a page is missing")
        own[0], own[2] = number + 1, bool(flags & LAST)
        packets, size, x = [], 0, begin
        for v in lacing:
            size += v
            if v < 255:
                packets.append(own[1] + media[x : x + size])
                own[1], x, size = b"", x + size, 0
        own[1] += media[x : x + size]
        streams[serial] += [(p, None) for p in packets[:-1]] + [(p, granule) for p in packets[-1:]]
        at = end
    if any(not ended or held for _, held, ended in state.values()):
        raise ValueError("a stream does not end")
    return streams


def decode(media: bytes) -> tuple[bytes, list[tuple[float, int]]]:
    """Samples, and (seconds, samples) of every packet in order of time."""
    timed: list[tuple[int, bytes]] = []
    total = 0
    for packets in demultiplex(media).values():
        header = packets[0][0]
        if header[:6] != _MAGIC:
            raise ValueError("not a stream of samples")
        _, streams, rate, size, total = struct.unpack("<BBIIQ", header[6:])
        end = None
        for p, granule in reversed(packets[1:]):  # from a stated end back through the packets before it
            # A packet ends one stride before the next of its stream; only the last may be shorter than the others.
            end = granule if granule is not None else end - last_length - (streams - 1) * size
            last_length = len(p)
            timed.append((end - len(p), p))
    timed.sort(key=lambda t: t[0])
    at = 0
    for start, p in timed:
        if start != at:
            raise ValueError("samples are missing")
        at += len(p)
    if at != total:
        raise ValueError("samples are missing")
    return b"".join(p for _, p in timed), [(start / rate, len(p)) for start, p in timed]


def features(samples: bytes, packets: list[tuple[float, int]]) -> str:
    """Duration, packet count, level and crossings of the middle, as a fixed string."""
    a = np.frombuffer(samples, np.uint8).astype(np.int64)
    high = a >= 100
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    return f"seconds={len(a) / RATE:.6f};packets={len(packets)};last={packets[-1][0]:.6f};mean={a.sum() / len(a):.6f};power={int((a * a).sum()) / len(a):.6f};crossings={crossings};peak={int(a.max())}"


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % BLOCK if data else BLOCK)


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], schema=_MEDIA)


def _decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, size, media in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media")):
            media = media.as_py()
            samples, packets = decode(media)
            rows.append((doc.as_py(), size.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(samples, packets)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FEATURES)], schema=_FEATURES)


def write_media(docs: DataFrame) -> DataFrame:
    """A staged table (doc_id, n_bytes, media): an Ogg file for every text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(docs.mapInArrow(_encoder, "doc_id long, n_bytes long, media binary"), "op4-media")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of the samples that the stored files hold."""
    return media.mapInArrow(_decoder, FEATURE_SCHEMA)


def op4_ogg_media_columns(spark, sf_dir: str) -> DataFrame:
    return read_media(write_media(table(spark, sf_dir, "documents")))
