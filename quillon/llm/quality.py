"""Quality classifier: attention-based multiple-instance learning (operator 8).

A document is a bag of passages of PASSAGE words (white-space runs; the last may be shorter). Every passage is
encoded from character and word statistics by a small tanh layer; gated attention weighs the passages and a
logistic unit scores their weighted sum. Document labels alone train all layers (Adam, on the
driver) on a bounded sample of whole documents: of those that are not held out the TRAIN_DOCS labelled ones that come
first by a hash of their id; one of these is left out if the sample would hold more than TRAIN_PASSAGES passages with it.
The fit uses every passage of a document of the sample. Scoring reads every passage of every whole text.

Defined cases: a null or empty text is one passage of zeros, scored like any other. A row with a null id is
scored, and held_out is false. Labels other than 0 and 1 are not used. Without labels of both classes
every score is the share of label 1, smoothed by one of each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._common import chunks, span_hashes, stage, table

PASSAGE, HASHED = 64, 24
#: The sample's documents and, over all of them, its passages (64 MB of features, 25 million words).
TRAIN_DOCS, TRAIN_PASSAGES = 4000, 400_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 16, 8, 25, 128, 0.01, 1e-4, 13
FEATURES = 16 + HASHED


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and the number of passages of each text (at least 1)."""
    rows, counts = [], []
    for lo, hi in chunks(texts, 1 << 19):
        x, n = _features(texts[lo:hi])
        rows.append(x)
        counts.append(n)
    return (np.concatenate(rows), np.concatenate(counts)) if rows else (np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64))


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    units = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    # A zero inside a text would shift the bounds: the lengths decide.
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.cumsum(sizes + 1)
    stop = np.zeros(len(units), bool)
    stop[bounds - 1] = True
    white = (units <= 32) | (units == 0xA0) | (units == 0x3000) | ((units >= 0x2000) & (units <= 0x200A)) | stop
    edge = np.flatnonzero(np.diff(np.concatenate([[1], white.view(np.int8), [1]])))
    starts, ends = edge[::2], edge[1::2]
    words = np.bincount(np.searchsorted(bounds, starts, side="right"), minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)
    counts = np.maximum(-(-words // PASSAGE), 1)
    n = int(counts.sum())
    out = np.zeros((n, FEATURES), np.float32)
    if not len(starts):
        return out, counts
    doc = np.repeat(np.arange(len(texts)), words)
    first_word = np.concatenate([[0], np.cumsum(words)[:-1]])
    first_passage = np.concatenate([[0], np.cumsum(counts)[:-1]])
    within = np.arange(len(starts)) - first_word[doc]
    passage = first_passage[doc] + within // PASSAGE
    new = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    own = passage[new]
    # Sums over the characters of each passage, from prefix sums.
    begin, end = starts[new], ends[np.append(new[1:], len(starts)) - 1]

    def total(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[end] - c[begin]).astype(np.float64)

    chars = np.maximum(end - begin, 1).astype(np.float64)
    ascii_letter = ((units | 32) >= 97) & ((units | 32) <= 122) & (units < 128)
    upper = (units >= 65) & (units <= 90) | (units >= 0xC0) & (units <= 0xDE) & (units != 0xD7)
    digit = (units >= 48) & (units <= 57)
    mark = (units > 32) & (units < 128) & ~ascii_letter & ~digit
    sentence = (units == 46) | (units == 44)
    out[own, 0] = total(upper) / chars
    out[own, 1] = total(digit) / chars
    out[own, 2] = total(mark) / chars
    out[own, 3] = total(sentence) / chars
    out[own, 4] = total(mark & ~sentence) / chars
    out[own, 5] = total(units >= 128) / chars
    out[own, 6] = total(units == 10) / chars
    out[own, 7] = total(ascii_letter) / chars
    length = (ends - starts).astype(np.float64)
    per = np.diff(np.append(new, len(starts))).astype(np.float64)
    mean = np.add.reduceat(length, new) / per
    out[own, 8] = mean / 10
    out[own, 9] = np.sqrt(np.maximum(np.add.reduceat(length * length, new) / per - mean * mean, 0)) / 10
    out[own, 10] = np.add.reduceat((length <= 3).astype(np.float64), new) / per
    out[own, 11] = np.maximum.reduceat(length, new) / 50
    h = span_hashes(units, starts, ends)
    order = np.lexsort((h, passage))
    ph, pp = h[order], passage[order]
    change = np.concatenate([[True], (ph[1:] != ph[:-1]) | (pp[1:] != pp[:-1])])
    at = np.flatnonzero(change)
    runs = np.diff(np.append(at, len(ph))).astype(np.float64)
    run_start = np.flatnonzero(np.concatenate([[True], pp[at][1:] != pp[at][:-1]]))
    out[own, 12] = np.diff(np.append(run_start, len(at))) / per
    out[own, 13] = np.maximum.reduceat(runs, run_start) / per
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])])
    out[own, 14] = np.add.reduceat(same.astype(np.float64), new) / per
    out[own, 15] = np.log1p(per) / 5
    bucket = (h >> np.uint64(40)).astype(np.int64) % HASHED
    out[:, 16:] = np.bincount(passage * HASHED + bucket, minlength=n * HASHED).reshape(n, HASHED) / np.maximum(np.bincount(passage, minlength=n), 1)[:, None]
    return out, counts


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class AttentionBag:
    """Gated-attention pooling over encoded passages (arrays only, so that tasks can receive it)."""

    def __init__(self, rng=None):
        rng = rng or np.random.default_rng(SEED)
        shape = {"e": (FEATURES, HIDDEN), "f": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": ()}
        self.p = {k: rng.standard_normal(s) / np.sqrt(s[0] if s else 1) if k not in "fb" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale, self.prior = np.zeros(FEATURES), np.ones(FEATURES), None

    def forward(self, x: np.ndarray, counts: np.ndarray):
        p, first = self.p, np.concatenate([[0], np.cumsum(counts)[:-1]])
        bag = np.repeat(np.arange(len(counts)), counts)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["e"] + p["f"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        raw = (t * g) @ p["w"]
        a = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return x, h, t, g, a, z, bag, first, _sigmoid(z @ p["c"] + p["b"])

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.prior is not None or not len(counts):
            return np.full(len(counts), 0.5 if self.prior is None else self.prior)
        return self.forward(x.astype(np.float64), counts)[-1]

    def gradients(self, x, counts, y, weight):
        x, h, t, g, a, z, bag, first, s = self.forward(x, counts)
        p = self.p
        d = (s - y) * weight / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        draw = a * (da - np.add.reduceat(a * da, first)[bag])
        dgate = draw[:, None] * p["w"]
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T
        dx = dh * (1 - h * h)
        return {"e": x.T @ dx, "f": dx.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ draw, "c": z.T @ d, "b": d.sum()}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> AttentionBag:
        if len(set(y.tolist())) < 2:
            self.prior = (float(y.sum()) + 1) / (len(y) + 2)
            return self
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0, dtype=np.float64), np.maximum(x.std(0, dtype=np.float64), 1e-3)
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                own = order[lo : lo + BATCH]
                rows = np.concatenate([np.arange(first[k], first[k] + counts[k]) for k in own])
                grads = self.gradients(x[rows], counts[own], y[own], weight[own])
                step += 1
                for k, g in grads.items():
                    g = g + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of each text as one row of bytes, and their number."""
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part = b.slice(lo, 64)
            x, counts = passage_features([t or "" for t in part.column("text").to_pylist()])
            bags = pa.array([p.tobytes() for p in np.split(x, np.cumsum(counts)[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), bags, pa.array(counts)], names=["doc_id", "quality", "x", "n"])


def fitting(sizes: list[int], most: int) -> list[int]:
    """Places of the sizes, in order, that are taken as long as all taken ones sum up to at most `most`."""
    taken, total = [], 0
    for k, n in enumerate(sizes):
        if total + n <= most:
            taken.append(k)
            total += n
    return taken


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES) -> AttentionBag:
    """Fit on at most train_docs whole labelled documents that are not held out, with at most train_passages passages together."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = marked.where(_remainder(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    # Twice the sample: labels may name documents that are absent. Bounded by the parameter.
    wanted = usable.orderBy(order, "doc_id").limit(2 * train_docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")
    # Passages are encoded before the order is made, so that no whole text is sorted or sent; the order is made on their numbers.
    coded = stage(own.select("doc_id", "quality", "text").mapInArrow(_encode, "doc_id long, quality int, x binary, n long").withColumn("mark", F.xxhash64("x")), "op8-coded")
    key = [order, F.col("doc_id"), F.col("mark")]
    first = coded.select("doc_id", "mark", "n").orderBy(*key).limit(train_docs).collect()
    ids = sorted({(first[k].doc_id, first[k].mark) for k in fitting([r.n for r in first], train_passages)})
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, mark long")  # train_docs rows at most
    got = coded.join(F.broadcast(chosen), ["doc_id", "mark"]).orderBy(*key).limit(train_docs).collect()
    got = [got[k] for k in fitting([r.n for r in got], train_passages)]
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    return AttentionBag().fit(x, np.array([len(b) for b in bags], np.int64), np.array([r.quality for r in got], np.float64))


def _scorer(model: AttentionBag):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("n_passages", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                texts = [t or "" for t in b.column("text").to_pylist()]
                scores, sizes = [], []
                for x, y in chunks(texts, 1 << 19):
                    f, counts = passage_features(texts[x:y])
                    scores.append(model.scores(f, counts))
                    sizes.append(counts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.concatenate(scores)), pa.array(np.concatenate(sizes).astype(np.int64))], schema=schema)

    return run


def score_documents(docs: DataFrame, model: AttentionBag) -> DataFrame:
    """(doc_id, held_out, score, n_passages) for every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_remainder(F.col("doc_id").cast("long")) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, n_passages long")


def accept(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier scores at least `least`, with their columns."""
    model = train(docs, labels)

    def score(text: pd.Series) -> pd.Series:
        texts = [t or "" for t in text]
        out = [model.scores(*passage_features(texts[x:y])) for x, y in chunks(texts, 1 << 19)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.where(F.pandas_udf(score, DoubleType())(docs["text"]) >= least)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_passages")
