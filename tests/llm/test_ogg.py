import hashlib
import random
import zlib

import pytest

from quillon.llm.ogg import checksum, decode, demultiplex, encode, padded, read_media, write_media

SCHEMA = "doc_id long, text string, media int"


def slow_checksum(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
            c &= 0xFFFFFFFF
    return c


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 5, 300):
        data = rng.randbytes(n)
        assert checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [192, 1920, 1920 + 192, 3840, 192 * 21, 130_560, 500_160])
def test_round_trip(size):
    payload = random.Random(size).randbytes(size)
    media = encode(payload)
    samples, packets = decode(media)
    assert samples == payload and len(demultiplex(media)) == 2
    assert [round(t * 8000) for t, _ in packets] == list(range(0, size, 1920))


def test_damage_is_found():
    media = bytearray(encode(bytes(range(192)) * 100))
    for at in range(0, len(media), 701):
        broken = bytearray(media)
        broken[at] ^= 4
        with pytest.raises(Exception):
            decode(bytes(broken))
    with pytest.raises(Exception):
        decode(bytes(media[:-1]))


def test_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "héé" * 50_000, 1), (None, "x", 1), (4, "a" * 192, 1), (4, "a" * 192, 1), (5, "naïve\n", 1)]
    got = read_media(write_media(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc, text, _ in rows:
        data = (text or "").encode()
        pay = data + b" " * ((-len(data)) % 192 or (0 if data else 192))
        r = by[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        assert r.media_sha256 == hashlib.sha256(encode(padded(data))).hexdigest()
    assert read_media(write_media(spark.createDataFrame([], SCHEMA))).count() == 0


def slow_file(payload):
    """The stored form by the container's rules alone: one segment at a time, a bitwise checksum, pages sorted by time at the end."""
    import struct

    serial, made = zlib.crc32(payload), []
    for s in (0, 1):
        header = b"PCM8\x00\x01" + bytes([s, 2]) + struct.pack("<IIQ", 8000, 1920, len(payload))
        segments = []  # (bytes, start sample of its packet, end sample if the packet ends here)
        for x in range(1920 * s, len(payload), 3840):
            packet = payload[x : x + 1920]
            for y in range(0, len(packet) + 1, 255):
                part = packet[y : y + 255]
                segments.append((part, x, x + len(packet) if len(part) < 255 else None))
        pages = [([(header, -1, 0)], 2 | (0 if segments else 4))]
        for k in range(0, len(segments), 255):
            flags = (1 if k and segments[k - 1][2] is None else 0) | (4 if k + 255 >= len(segments) else 0)
            pages.append((segments[k : k + 255], flags))
        for n, (own, flags) in enumerate(pages):
            ends = [e for _, _, e in own if e is not None]
            body = b"".join(p for p, _, _ in own)
            head = b"OggS\0" + bytes([flags]) + struct.pack("<qIII", ends[-1] if ends else -1, serial ^ s, n, 0) + bytes([len(own), *(len(p) for p, _, _ in own)])
            head = head[:22] + struct.pack("<I", slow_checksum(head + body)) + head[26:]
            made.append((own[0][1], s, n, head + body))
    return b"".join(m[3] for m in sorted(made, key=lambda m: m[:3]))


def slow_feature(payload):
    n, high = len(payload), [b >= 100 for b in payload]
    crossings = sum(a != b for a, b in zip(high, high[1:]))
    starts = range(0, n, 1920)
    return f"seconds={n / 8000:.6f};packets={len(starts)};last={starts[-1] / 8000:.6f};mean={sum(payload) / n:.6f};power={sum(b * b for b in payload) / n:.6f};crossings={crossings};peak={max(payload)}"


def test_stored_form_and_feature_by_hand(spark):
    texts = ["", "x", "a\nb" * 900, "naïve text " * 400, "z" * 3840, "y" * 1920, "long one " * 20_000]
    got = {r.doc_id: r for r in read_media(write_media(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], SCHEMA))).collect()}
    for k, t in enumerate(texts):
        data = t.encode()
        pay = data + b" " * ((-len(data)) % 192 or (0 if data else 192))
        media = slow_file(pay)
        assert (got[k].media_bytes, got[k].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert got[k].feature == slow_feature(pay)
