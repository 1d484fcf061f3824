import random

import pytest
from tokenizers import Tokenizer

from quillon.llm import token_counts
from quillon.llm.packing import default_tokenizer
from quillon.llm.token_counts import GUARD, TokenCounter, count_tokens, long_texts, op13_token_counts, stable

SCHEMA = "doc_id long, text string"
ODD = [None, "", " ", "\n\t", "It's 'tis we'll", "ÀÉß ſtraße ½", "İstanbul ΑΣ", "é́", "a<|endoftext|>b<|startoftext|>", "日本語 テスト", "\x85\x1c", "emoji 😀!!", "ABC 123abc"]
CHUNK, OVERLAP = 400, 150


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def long_ones(seed=1):
    rng = random.Random(seed)
    words = ["it's", "we'll", "ÀÉß", "straße", "don't", "x", "2024", "...", "!!", "naïve", "日本語", "ΑΣ", "é́́", "<|endoftext|>", "각", "नमस्ते", "a.b,c--d", "​", "’s"]
    soup = lambda n, joint: joint.join(rng.choice(words) for _ in range(n))
    return [
        soup(900, " "),
        soup(900, "\n"),
        soup(700, ""),  # hardly a place without special tokens, marks or letters beside it
        " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(900)),
        "a" * 5000,  # no place at all
        "ab " * 300 + "c" * 3000 + " de" * 300,  # a gap wider than a chunk
        "!?" * 1500,
        "7" * 2500,
        "e" + "́" * 2500,
        "<|endoftext|>" * 300,
        "<|startoftext|" * 300,
        " " * 4000,
        "'s" * 1500,
        "w" * 700 + " x" * 20 + "y" * 900,
        "ᄀ" + "ᅡ" * 1500,
    ]


def test_every_text_is_counted_as_the_tokenizer_does(spark, plain):
    texts = [*ODD, *long_ones()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (3, texts[-2]), (3, texts[-2]), (3, "other")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", token_counts.F.lit("clash")).withColumn("digest", token_counts.F.lit(1))
    got = count_tokens(frame, chunk=CHUNK, overlap=OVERLAP, limit=600).collect()
    want = sorted((str(i), len((t or "").encode()), plain(t), plain(t) > 600) for i, t in rows)
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_all_scripts(spark, plain, seed):
    rng = random.Random(seed)
    pool = "abcXYZ '\n.,-0123<|>éß" + "ΣσςİıſÅ각ᅡᆨ̣́日本नमस्ते😀‍"
    texts = ["".join(rng.choice(pool[: rng.choice([12, 22, len(pool)])]) for _ in range(rng.randint(600, 3000))) for _ in range(40)]
    got = count_tokens(spark.createDataFrame(list(enumerate(texts)), SCHEMA), chunk=CHUNK, overlap=OVERLAP).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_failed_seams_widen_until_they_join(spark, plain):
    """The same texts with an overlap that is hardly wider than the guard, and with a wide one."""
    texts = {f"d{k}": t for k, t in enumerate(long_ones(7)) if len(t) > 300}
    frame = spark.createDataFrame(list(texts.items()), "digest string, text string")
    for overlap in (GUARD + 1, 200):
        got = {r.digest: r.n_tokens for r in long_texts(frame, default_tokenizer(), 400, overlap).collect()}
        assert got == {k: plain(t) for k, t in texts.items()}
    with pytest.raises(ValueError):
        long_texts(frame, default_tokenizer(), 400, 300)


def test_words_lie_where_the_tokenizer_puts_them(plain):
    own = TokenCounter(default_tokenizer())
    for text in (t for t in [*ODD, *long_ones(3)] if t):
        at, before, total = own.places(text)
        assert total == plain(text) and len(at) == len(before)
        for p, n in list(zip(at, before))[:: max(1, len(at) // 25)]:
            if stable(text[p]) and "<|" not in text:
                assert plain(text[p:]) == total - n, (text[:40], p)


def test_empty_table(spark):
    got = count_tokens(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == 0


def test_query_counts_whole_documents(spark, plain):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: (len((r.text or "").encode()), plain(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_token_counts(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)
