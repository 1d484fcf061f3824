import base64
import hashlib

import pytest
import zstandard

from quillon.llm.warc import BundleWriter, build_record, parse_record, read_bundles, read_frame, read_record, record_id, seek_table, write_bundles

SCHEMA = "page_id long, url string, html string, sha int"


def test_bundle_round_trip_and_random_access():
    w = BundleWriter(frame=1000)
    records = [(k, f"http://h/{k}", (f"é{k}" * (k * 7)).encode()) for k in range(60)]
    for k, url, body in records:
        w.add(record_id(k), build_record(k, url, body, None if k % 3 else 0))
    index, data = w.index, w.finish()
    frames = seek_table(data)
    assert len(frames) > 3
    # A plain decoder skips the table and sees all records.
    whole = b"".join(read_frame(data, f) for f in frames)
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as r:
        assert r.read() == whole
    for (name, frame, offset), (k, url, body) in zip(index, records):
        head, http, payload, _ = read_record(data, frame, offset)
        assert head["WARC-Record-ID"] == name == record_id(k) and head["WARC-Target-URI"] == url
        assert payload == (body if k % 3 else b"") and int(http["Content-Length"]) == len(body)
    damaged = bytearray(data)
    damaged[frames[1][0] + 20] ^= 1
    with pytest.raises(Exception):
        read_frame(bytes(damaged), frames[1])


def brute(rows):
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            p = (html or "").encode()
            first[p] = min(first.get(p, page), page)
    out = []
    for page, _, html, *_ in rows:
        p = (html or "").encode()
        again = page is not None and page != first[p]
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_query_matches_brute_force(spark):
    rows = [(k, f"http://h{k % 3}/a b\n{k}", f"<p>{k % 40} ü</p>" * (k % 9), 1) for k in range(400)]
    rows += [(1000, None, None, 1), (1001, "u", "", 1), (None, "u", "<p>1 ü</p>", 1), (1002, "u", "x" * 3_000_000, 1), (5, "http://h2/a b\n5", "<p>5 ü</p>" * 5, 1)]
    got = read_bundles(write_bundles(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(key, (tuple(r)[:5] for r in got.collect()))) == sorted(map(key, brute(rows)))


def test_small_payloads_and_empty_table(spark):
    got = read_bundles(write_bundles(spark.createDataFrame([(1, "u", "ab", 1), (2, "u", "ab", 1)], SCHEMA), min_bytes=3)).collect()
    assert [r.record_type for r in got] == ["response", "response"]
    assert read_bundles(write_bundles(spark.createDataFrame([], SCHEMA))).count() == 0


def test_cut_record():
    with pytest.raises(ValueError):
        parse_record(build_record(1, "u", b"abc", None)[:-5])
