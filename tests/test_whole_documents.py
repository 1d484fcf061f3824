"""Queries over documents read whole texts, of any length: compared with brute force."""

import hashlib
import random
import re

import pytest

from quillon import catalog


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["the", "and", "der", "los", "GATC", "cgATG", "ab", "abc", "four", "longer", "x_y", "a|b,c", "1;2"]
    rows = {k: " ".join(rng.choice(words) for _ in range(n)) for k, n in enumerate([1, 5, 40, 700, 1200, 6000])}
    # What decides stands behind every old limit.
    rows[10] = "longer " * 1000 + "abc ATG the"
    rows[11] = ""
    d = str(tmp_path_factory.mktemp("documents"))
    data = [(k, x, "en", "s", len(x)) for k, x in rows.items()]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d, rows


def run(spark, name, d):
    return {r.doc_id: tuple(r)[1:] for r in catalog.queries()[name](spark, d).collect()}


def test_sequence_features(spark, texts):
    d, rows = texts
    want = {}
    for k, x in rows.items():
        s = re.sub("[^ACGT]", "", x.upper())
        back = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        gc = round(len(re.findall("[GC]", s)) / len(s), 6) if s else None
        want[k] = (gc, s.count("CG"), s.count("ATG"), hashlib.md5(back.encode()).hexdigest())
    assert run(spark, "sequence_features", d) == want


def test_source_reads(spark, texts):
    d, rows = texts
    found = {k: [w for w in re.findall("[A-Za-z]+", x) if w in ("the", "and", "der", "los")] for k, x in rows.items()}
    assert run(spark, "source_reads", d) == {k: (len(f), ",".join(sorted(set(f)))) for k, f in found.items()}


def test_parse_labels(spark, texts):
    d, rows = texts
    toks = {k: {w for w in re.split(r"[+_|,;\s]+", x) if w} for k, x in rows.items()}
    assert run(spark, "parse_labels", d) == {k: ("+".join(sorted(w for w in t if len(w) <= 3)), sum(len(w) > 3 for w in t)) for k, t in toks.items()}


def test_match_labels(spark, texts):
    d, rows = texts
    want = {}
    for k, x in rows.items():
        t = set(re.split(r"[+_|,;\s]+", x.lower()))
        n = sum(len(w) == 4 for w in t)
        want[k] = ("control" if "the" in t else "other" if n == 0 else "single" if n == 1 else "multi", n)
    assert run(spark, "match_labels", d) == want
