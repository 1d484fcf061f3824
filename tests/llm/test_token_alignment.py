import hashlib
import random
from collections import Counter, defaultdict

import pytest

from quillon.llm.token_alignment import Aligner, Pair, _steps, align, default_tokenizers, op12_cross_tokenizer_alignment

SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "  ", "\n", "\n\n x", "a", " a", "a ", "It's we'll  two   spaces\tand\ttabs", "line\nline\n\nlast\n", "ÀÉß ſtraße ½ naïve", "a<|endoftext|>b </s> <s> <unk> <0x41>",
    "日本語 テスト。中文字符", "emoji 😀😀‍!! 👩‍👩‍👧", "a▁b", "▁", "x ▁ y", "a  b c　d\x85e\x1cf", "٣٤ नमस्ते", "é́", "\x00 a\x01b", "12345 67890", "mixed \n \n ends \r\n here", "ﬁ ﷺ ㎏", "﻿bom",
]


@pytest.fixture(scope="module")
def pair():
    return Pair(*default_tokenizers())


def brute(pair, texts):
    """Whole texts through the tokenizers themselves, and every token against every other."""
    tokens, holds = [], defaultdict(int)
    for text in texts:
        own = None
        if text:
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            if b"".join(pair.a_bytes[i] for i in a) == b"".join(pair.b_bytes[i] for i in b) == (" " + text).encode():
                spans = []
                for ids, sizes in ((a, pair.a_bytes), (b, pair.b_bytes)):
                    at, rows = 0, []
                    for i in ids:
                        rows.append((at, at + len(sizes[i]), i))
                        at += len(sizes[i])
                    spans.append(rows)
                links = []
                for s, e, x in spans[0]:
                    links += [(x, y) for t, f, y in spans[1] if s < f and t < e]
                ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                groups, lo = [], 0
                for hi in ends:
                    groups.append("|".join(",".join(str(i) for s, e, i in rows if lo <= s < hi) for rows in spans))
                    lo = hi
                own = (len(a), len(b), links, groups)
                for p in set(links):
                    holds[p] += 1
        tokens.append(own)
    top = defaultdict(int)
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    out = []
    for own in tokens:
        if own is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = own
            out.append((n_a, n_b, len(groups), len(links), sum(holds[p] == top[p[0]] for p in links), sum(holds[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def compare(pair, got, ids, texts):
    want = Counter((i, *r) for i, r in zip(ids, brute(pair, texts)))
    found = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect())
    assert found == want, (sorted((found - want).items(), key=str)[:3], sorted((want - found).items(), key=str)[:3])


def soup(rng, n):
    words = ["the", "of", "naïve", "x1", "😀", "日本", "it's", "don't", "...", "a▁b" if rng.random() < 0.02 else "ab", "   ", "\n", "\t", "№", "é"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "", "  "]) for _ in range(n))


@pytest.mark.parametrize("chunk, step, units", [(1 << 21, 1 << 19, 100_000), (300, 50, 20), (1, 1, 1)])
def test_equals_brute_force_at_any_step(spark, pair, chunk, step, units):
    rng = random.Random(chunk)
    texts = [*ODD, *(soup(rng, rng.randint(1, 60)) for _ in range(40)), ODD[9], ODD[9]]
    ids = [*range(len(texts) - 2), None, 9]
    frame = spark.createDataFrame(list(zip(ids, texts)), SCHEMA).repartition(3)
    clash = frame.selectExpr("*", "1 AS n_a", "'x' AS pair", "text AS docs", "2 AS chunk")
    compare(pair, align(clash, chunk=chunk, step=step, units=units), ids, texts)


def test_real_documents(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").select("doc_id", "text")
    rows = docs.collect()
    compare(pair, align(docs), [r.doc_id for r in rows], [r.text for r in rows])


def test_units_join_to_the_text_and_their_tokens_to_its_tokens(pair):
    rng = random.Random(5)
    for text in [*(t for t in ODD if t), *(soup(rng, 80) for _ in range(60))]:
        for step in (1, 7, 1000):
            units = [u for s in _steps(text, step) for u in s]
            assert "".join(units) == " " + text
        whole, parts = pair.encode([" " + text]), [pair.encode([u]) for u in units]
        if all(p is not None for p in parts):
            for side in (0, 1):
                assert [i for p in parts for i in p[side].tolist()] == whole[side].tolist(), text
        else:
            assert whole is None, text


def test_units_learnt_together_are_aligned_as_alone(pair):
    units = [" x", " ", "\n", " y \n", " z", "  ", " w", "\nv", " a▁", " b"]
    together = Aligner(pair)
    together.learn(units)
    for u in units:
        alone = Aligner(pair)
        alone.learn([u])
        k = together.known[u]
        assert together.texts[k] == alone.texts[0] and together.numbers[k].tolist() == alone.numbers[0].tolist(), repr(u)


def test_empty_table_and_query(spark):
    got = align(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert op12_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
