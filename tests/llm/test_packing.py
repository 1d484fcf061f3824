import math
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from quillon.llm import packing
from quillon.llm.packing import TokenBytes, default_tokenizer, pack, solve

SCHEMA = "doc_id long, text string, length int"
ODD = ["", " ", "It's 'tis we'll I'd''s !!'s x'", "ÀÉß ſtraße ½ 2³ª", "ΑΣ ΣΑΣ", "İstanbul", "é́", "a<|endoftext|>b", "日本語 テスト", "a b c\x85d\x1ce", "emoji 😀!!", "ABC 123abc", "A.B,c--d"]


def test_tokens_equal_the_tokenizer():
    rng = random.Random(3)
    chars = "abcdeABC' 's't.!?0123äöüßÉñ\n\tſ<|>"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 120))) for _ in range(2000)]
    plain = Tokenizer.from_file(default_tokenizer())
    got = TokenBytes(default_tokenizer())(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_solution_holds_every_piece_and_is_near_the_bound():
    rng = random.Random(5)
    histogram = defaultdict(int)
    for _ in range(20000):
        histogram[min(4096, max(1, int(rng.lognormvariate(6, 1.2))))] += 1
    held, sequences = defaultdict(int), 0
    for config, n in solve(dict(histogram)):
        assert n > 0 and sum(k * a for k, a in config) <= 4096
        sequences += n
        for k, a in config:
            held[k] += n * a
    assert held == histogram
    bound = math.ceil(sum(k * n for k, n in histogram.items()) / 4096)
    assert sequences <= bound * 1.003 + 1
    assert solve({}) == []
    assert sum(n for _, n in solve({4095: 7, 1: 7})) == 7


def share_of_configurations(histogram):
    tokens = sum(k * a * n for config, n in packing.configure(histogram).items() for k, a in config)
    return tokens / sum(k * n for k, n in histogram.items() if k < 4096)


def test_configurations_enter_beside_short_pieces():
    rng = random.Random(5)
    histogram = defaultdict(int)
    for _ in range(20000):
        histogram[max(3, int(rng.lognormvariate(6, 1.2))) % 4096 or 4096] += 1
    assert histogram[3] and share_of_configurations(dict(histogram)) > 0.3


def test_fewer_sequences_than_best_fit():
    rng = random.Random(6)
    histogram = defaultdict(int)
    for _ in range(100_000):
        histogram[rng.randint(1030, 2048)] += 1
    histogram |= {3: 40, 4: 9}
    best_fit = sum(n for _, n in packing._best_fit(dict(histogram), 4096))
    assert sum(n for _, n in solve(dict(histogram))) < 0.99 * best_fit


def test_rounds_go_on_until_the_configurations_cover_the_histogram():
    rng = random.Random(8)
    for least, most, gap in ((700, 2048, 1.006), (1030, 2048, 1.06)):
        histogram = defaultdict(int)
        for _ in range(200_000):
            histogram[rng.randint(least, most)] += 1
        bound = math.ceil(sum(k * n for k, n in histogram.items()) / 4096)
        assert share_of_configurations(dict(histogram)) >= 0.99 - 1e-3
        assert sum(n for _, n in solve(dict(histogram))) <= gap * bound


def check(rows, got):
    plain = Tokenizer.from_file(default_tokenizer())
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for doc, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and r.length == min(4096, len(ids) - r.start)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096


def test_rows(spark):
    rng = random.Random(7)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (101, "word " * 4095), (102, "word " * 4096), (103, "word " * 30000)]
    rows += [(200 + k, "copy of this text") for k in range(300)]
    rows += [(1000 + k, "some words " * rng.randint(1, 900)) for k in range(200)]
    got = pack(spark.createDataFrame([(a, b, 1) for a, b in rows], SCHEMA)).collect()
    check(rows, got)


def test_null_ids_repeats_and_empty_table(spark):
    got = pack(spark.createDataFrame([(None, "x", 1), (1, "a", 1), (1, "a", 1)], SCHEMA)).collect()
    assert sorted((r.offset, r.sequence_id) for r in got) == [(0, 0), (2, 0), (4, 0)]
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
