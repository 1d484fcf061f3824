import math
import random
import zlib

import numpy as np

from quillon.llm.quality import FEATURES, AttentionBag, accept, passage_features, fitting, score_documents, train

SCHEMA = "doc_id long, text string, score double, quality string"
LABELS = "doc_id long, quality int, toxic int"


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    counts = np.array([1, 3, 5, 2])
    x, y, weight = rng.standard_normal((11, FEATURES)), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    model = AttentionBag(rng)

    def loss():
        s = model.forward(x, counts)[-1]
        return float((-(y * np.log(s) + (1 - y) * np.log(1 - s)) * weight).mean())

    grads = model.gradients(x, counts, y, weight)
    for k, g in grads.items():
        flat = np.atleast_1d(model.p[k])
        at = tuple(d // 2 for d in flat.shape)
        if not model.p[k].shape:
            model.p[k] = flat
        for sign in (1,):
            old = model.p[k][at]
            model.p[k][at] = old + 1e-6
            up = loss()
            model.p[k][at] = old - 1e-6
            down = loss()
            model.p[k][at] = old
        assert abs((up - down) / 2e-6 - np.atleast_1d(g)[at]) < 1e-6


def test_features_do_not_depend_on_the_batch():
    texts = ["Some words, here.", "", "  ", "a " * 500, "A\0B c\0", "ünï cödé 123 !!", "x" * 70_000]
    x, counts = passage_features(texts)
    assert counts.tolist() == [1, 1, 1, 8, 1, 1, 1] and np.isfinite(x).all()
    for k, t in enumerate(texts):
        alone, n = passage_features([t])
        at = counts[:k].sum()
        assert np.allclose(alone, x[at : at + n[0]], atol=1e-6)
    assert passage_features([])[0].shape == (0, FEATURES)


def corpus():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 400))]
        good = rng.random() < 0.7
        if not good:  # junk in one part of the document only
            at = rng.randrange(max(1, len(words) - 20))
            words[at : at + 64] = [w.upper() + "!!" for w in words[at : at + 64]]
        rows.append((k, " ".join(words), 0.0, "x"))
        labels.append((k, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    model = train(docs, marks)
    got = {r.doc_id: r for r in score_documents(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [k for k in got if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (k in set(held)) for k in got)
    truth = {a: q for a, q, _ in labels}
    assert sum((got[k].score >= 0.5) == truth[k] for k in held) / len(held) > 0.95
    kept = {r.doc_id for r in accept(docs, marks).collect()}
    assert kept == {k for k, r in got.items() if r.score >= 0.5}


def test_odd_rows(spark):
    rows = [(None, "text", 0.0, "x"), (1, None, 0.0, "x"), (2, "", 0.0, "x"), (2, "", 0.0, "x"), (3, "w " * 100_000, 0.0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], LABELS)
    got = score_documents(docs, train(docs, none)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(2, 1, 0), (3, None, 0), (None, 1, 0), (5, 7, 0)], LABELS)
    assert {r.score for r in score_documents(docs, train(docs, odd)).collect()} <= {0.5, 2 / 3}
    empty = spark.createDataFrame([], SCHEMA)
    assert score_documents(empty, train(docs, none)).count() == 0


def test_long_documents_are_in_the_fit(spark):
    assert fitting([5, 3, 9, 2, 1], 10) == [0, 1, 3] and fitting([], 1) == [] and fitting([4], 3) == []
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(60):  # all labelled documents are long; junk stands near the end
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(6000)]
        if k % 2:
            words[4500:] = [w.upper() + "!!" for w in words[4500:]]
        rows.append((k, " ".join(words), 0.0, "x"))
        labels.append((k, 1 - k % 2, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.score for r in score_documents(docs, train(docs, spark.createDataFrame(labels, LABELS))).collect()}
    assert all((got[k] >= 0.5) == (k % 2 == 0) for k in got)
    # The sample's bound is on whole documents: 94 passages each.
    few = train(docs, spark.createDataFrame(labels, LABELS), train_passages=94 * 20)
    got = {r.doc_id: r.score for r in score_documents(docs, few).collect()}
    assert all((got[k] >= 0.5) == (k % 2 == 0) for k in got)


def test_every_passage_is_in_the_fit(spark):
    """One passage of junk at any place of a long document is enough to tell it, so none may be left out."""
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(240):
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(64 * 100)]
        if k % 2:
            at = 64 * rng.randrange(100)
            words[at : at + 64] = ["XX!!"] * 64
        rows.append((k, " ".join(words), 0.0, "x"))
        labels.append((k, 1 - k % 2, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in score_documents(docs, train(docs, spark.createDataFrame(labels, LABELS))).collect()}
    held = [k for k in got if got[k].held_out]
    assert sum((got[k].score >= 0.5) == (k % 2 == 0) for k in held) / len(held) > 0.95


def test_scores_match_plain_python():
    rng = np.random.default_rng(5)
    counts = np.array([2, 1, 7])
    x = rng.standard_normal((10, FEATURES)) * 2
    model = AttentionBag(rng)
    model.mean, model.scale = rng.standard_normal(FEATURES), rng.uniform(0.5, 2, FEATURES)
    p = {k: v.tolist() for k, v in model.p.items() if k != "b"}
    hidden, gate = range(len(p["f"])), range(len(p["w"]))
    sigmoid = lambda t: 1 / (1 + math.exp(-t))
    want, at = [], 0
    for n in counts:
        bag = []
        for row in x[at : at + n]:
            z = [min(8, max(-8, (row[j] - model.mean[j]) / model.scale[j])) for j in range(FEATURES)]
            h = [math.tanh(sum(z[j] * p["e"][j][k] for j in range(FEATURES)) + p["f"][k]) for k in hidden]
            raw = sum(p["w"][g] * math.tanh(sum(h[k] * p["v"][k][g] for k in hidden)) * sigmoid(sum(h[k] * p["u"][k][g] for k in hidden)) for g in gate)
            bag.append((math.exp(raw), h))
        whole = sum(a for a, _ in bag)
        want.append(sigmoid(sum(a / whole * h[k] * p["c"][k] for a, h in bag for k in hidden) + float(model.p["b"])))
        at += n
    assert np.allclose(model.scores(x, counts), want, atol=1e-12)
