"""Whitening of embeddings by merged moments (operator 11).

Every partition sums up its vectors batch by batch as count, mean and centred scatter; two such summaries merge by
Chan's formula, scatter = A + B + d d' na nb / (na + nb) with d the difference of the means, and treeAggregate merges
those of the partitions in rounds of FAN, so that the driver gets a few matrices of dimensions x dimensions, whatever
the number of vectors. Sums of the integers are kept beside them, exactly. The driver decomposes the covariance; a second pass sums up the
whitened vectors in the same way and gives their covariance's distance from the identity; a third one returns them.

Defined cases: vectors that are null, empty or hold null or non-finite entries, or entries whose 64-fold is no long, are dropped.
Of vectors of several lengths those of the most frequent length stay (of equally frequent ones the longest). Repeated rows and rows with a null id count like any others.
Components without variance (at most LEAST of the trace) cannot be scaled to 1 and are not returned: a table of
equal vectors, of one vector or of none gives no rows. A deviation beyond the longs is null.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Share of the trace that a component's eigenvalue must exceed, and summaries merged in one task of a round.
LEAST, FAN = 1e-12, 4
#: Numbers of vectors that are summed up at once.
STEP_CELLS = 1 << 20
_LONG = float(1 << 62)

#: A summary by vector length: count, exact sums of the integers, mean and centred scatter.
Moments = dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]]


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(SCALE * entries) as int64) of the valid vectors, for each vector length."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # without what null lists may cover
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        bad = ~(np.abs(scaled) < _LONG)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    odd = np.concatenate([[0], np.cumsum(bad)])
    valid = (lengths > 0) & (odd[starts + lengths] == odd[starts])
    for length in np.unique(lengths[valid]):
        rows = np.flatnonzero(valid & (lengths == length))
        step = max(1, STEP_CELLS // int(length))
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            yield own, scaled[starts[own][:, None] + np.arange(length)].astype(np.int64)


def summary(y: np.ndarray) -> Moments:
    """Of integer vectors, one a row."""
    n, d = y.shape
    small = int(np.abs(y).max(initial=0)) * n < 1 << 62
    sums = y.sum(0).astype(object) if small else y.astype(object).sum(0)
    origin = y[0]  # near the others: what is subtracted before doubles are made
    z = (y - origin).astype(np.float64)
    mean = z.mean(0)
    z -= mean
    return {d: (n, sums, origin + mean, z.T @ z)}


def whitened_summary(w: np.ndarray) -> Moments:
    mean = w.mean(0)
    c = w - mean
    return {w.shape[1]: (len(w), np.zeros(w.shape[1], object), mean, c.T @ c)}


def merge(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise formula for every vector length."""
    out = dict(a)
    for d, (nb, sb, mb, cb) in b.items():
        if d not in out:
            out[d] = (nb, sb, mb, cb)
            continue
        na, sa, ma, ca = out[d]
        n, delta = na + nb, mb - ma
        out[d] = (n, sa + sb, ma + delta * (nb / n), ca + cb + np.outer(delta, delta) * (na * nb / n))
    return out


def _merged(rows: DataFrame, of_batch) -> Moments:
    """Moments of all partitions of rows, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Moments = {}
        for b in batches:
            for part in of_batch(b):
                own = merge(own, part)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["state"])

    states = rows.mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r.state))
    depth = max(2, math.ceil(math.log(max(states.getNumPartitions(), 1), FAN)))
    return states.treeAggregate({}, merge, merge, depth)


def fit(vectors: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(length, n, sums, covariance) of a column `embedding`; None without vectors."""
    moments = _merged(vectors, lambda b: (summary(y) for _, y in integers(b.column("embedding"))))
    if not moments:
        return None
    d = max(moments, key=lambda k: (moments[k][0], k))
    n, sums, _, scatter = moments[d]
    return d, n, sums, scatter / n


def axes(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Falling eigenvalues above LEAST of the trace, their unit eigenvectors as columns, and the trace."""
    trace = float(np.trace(covariance))
    values, vectors = np.linalg.eigh(covariance)
    keep = [k for k in np.argsort(-values, kind="stable")[:most] if values[k] > LEAST * trace]
    return values[keep], vectors[:, keep], trace


def centred(y: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """y less its mean, and the exact sums over a row of (n * y - sums) ** 2; None beyond the longs."""
    d = y.shape[1]
    most = n * float(np.abs(y).max(initial=0)) + float(max(map(abs, sums), default=0))
    if most < _LONG:
        difference = n * y - sums.astype(np.int64)
        apart = difference / n
        if float(np.abs(difference).max(initial=0)) ** 2 * d < _LONG:
            return apart, (difference * difference).sum(1).tolist()
        exact = difference.astype(object)
    else:
        exact = n * y.astype(object) - sums
        apart = np.array([[v / n for v in row] for row in exact], np.float64).reshape(y.shape)
    squares = [int(v) for v in (exact * exact).sum(1)]
    return apart, [v if v < 1 << 63 else None for v in squares]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each valid row of embeddings (vec_id, embedding) and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fitted = fit(rows.select("embedding"))
    values = np.zeros(0)
    if fitted:
        d, n, sums, covariance = fitted
        values, vectors, trace = axes(covariance, components)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    k = len(values)
    project = vectors / np.sqrt(values)

    def parts(b: pa.RecordBatch):
        for own, y in integers(b.column("embedding")):
            if y.shape[1] == d:
                apart, deviation = centred(y, n, sums)
                yield own, apart @ project, deviation

    again = _merged(rows, lambda b: (whitened_summary(w) for _, w, _ in parts(b)))
    count, _, _, scatter = again[k]
    error = float(np.abs(scatter / count - np.eye(k)).max())
    explained = values / trace
    fields = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, w, deviation in parts(b):
                m = len(own)
                ids, at = b.column("vec_id").take(pa.array(own)), pa.array(np.repeat(np.arange(m), k))
                columns = [ids.take(at), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), pa.array(deviation, pa.int64()).take(at), w.ravel(), np.tile(explained, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, fields)], schema=fields)

    return rows.mapInArrow(run, schema)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
