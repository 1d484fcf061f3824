"""Singular values and vectors of matrices in long rows, whose rows stay on the executors.

A pass over the matrix multiplies blocks of rows with a thin matrix (columns x rank) and adds up thin results in a tree of
tasks; only such thin matrices, and one name a column, reach the driver. Orthogonal bases of tall products come from QR
factors merged in the same tree (the QR of stacked triangles), which keeps small singular values that a Gram matrix would lose.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Columns up to which all singular values come from one pass, and vectors beyond those asked for in the range of a larger matrix.
EXACT, BESIDE = 256, 8
#: Relative change of the singular values at which the range is taken as found, and passes after which it must be.
TOLERANCE, PASSES = 1e-9, 60
#: Cells of a block of rows, replicates of one pass, states merged in one task of a round.
CELLS, REPLICATES, FAN = 1 << 21, 8, 4


def matrix_rows(long: DataFrame, row: str, column: str, value: str) -> tuple[DataFrame, list]:
    """(row, at, x): the values of each row by the places of its columns, and the columns' names in order. NULL and NaN count as 0, values of one cell are added."""
    long = cut(long.select(row, column, value))
    x = F.col(value).cast("double")
    cells = long.where(x.isNotNull() & ~F.isnan(x)).groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(F.sum(x).alias("x"))
    names = sorted(r[0] for r in long.select(column).distinct().collect())  # one name a column
    kind = long.schema[column].dataType.simpleString()
    places = long.sparkSession.createDataFrame(list(zip(names, range(len(names)))), f"column {kind}, at int")
    rows = cells.join(places, "column").groupBy("row").agg(F.collect_list(F.struct("at", "x")).alias("c"))  # as long as there are columns
    return cut(rows.select("row", F.col("c.at").alias("at"), F.col("c.x").alias("x"))), names


def _order(replicate: int, row, n: int) -> np.ndarray:
    """A permutation that depends on the replicate and the row alone, so that it is the same wherever the row is read again."""
    seed = hashlib.sha256(f"{replicate}:{row}".encode()).digest()[:16]
    return np.random.Generator(np.random.PCG64(int.from_bytes(seed, "little"))).permutation(n)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray]]:
    """Names and dense values of some rows at a time."""
    step = max(1, CELLS // max(1, width))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            part = b.slice(lo, step)
            at, x = part.column("at"), part.column("x")
            own = np.repeat(np.arange(part.num_rows), at.value_lengths().to_numpy())
            block = np.zeros((part.num_rows, width))
            block[own, at.flatten().to_numpy()] = x.flatten().to_numpy()
            yield part.column("row").to_pylist(), block


def _fold(rows: DataFrame, width: int, replicates: list[int], of_block: Callable[[int, np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """of_block(replicate, block of rows) merged over the whole matrix, for each replicate; -1 is the matrix as it is."""

    def both(a: dict, b: dict) -> dict:
        return {k: merge(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        for names, block in _blocks(batches, width):
            part = {}
            for rep in replicates:
                seen = block if rep < 0 else np.array([r[_order(rep, n, width)] for n, r in zip(names, block)])
                part[rep] = of_block(rep, seen)
            own = both(own, part)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["state"])

    states = rows.mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r.state))
    return states.treeAggregate({}, both, both, max(2, math.ceil(math.log(max(states.getNumPartitions(), 1), FAN))))


def _triangle(m: np.ndarray) -> np.ndarray:
    return np.linalg.qr(m, mode="r")


def _stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _triangle(np.vstack([a, b]))


def _ranges(rows: DataFrame, width: int, replicates: list[int], k: int) -> dict[int, np.ndarray]:
    """An orthonormal columns x rank matrix for each replicate that spans its first k right singular vectors.

    A block Krylov basis of the columns' Gram matrix, which is never formed: each pass multiplies the newest block by it. All replicates
    start from the same random block.
    """
    size = min(width, k + BESIDE)
    start = np.linalg.qr(np.random.default_rng(7).standard_normal((width, size)))[0]
    newest = dict.fromkeys(replicates, start)
    basis = dict.fromkeys(replicates, np.zeros((width, 0)))
    image = dict.fromkeys(replicates, np.zeros((width, 0)))
    before, out = {}, {}
    for _ in range(PASSES):
        found = _fold(rows, width, [*newest], lambda rep, block: block.T @ (block @ newest[rep]), np.add)  # noqa: B023
        for rep in [*newest]:
            basis[rep], image[rep] = np.hstack([basis[rep], newest[rep]]), np.hstack([image[rep], found[rep]])
            h = basis[rep].T @ image[rep]
            values, vectors = np.linalg.eigh((h + h.T) / 2)
            top = np.argsort(-values)[:size]
            now = np.sqrt(np.maximum(values[top[:k]], 0))
            w = found[rep]
            for _ in range(2):
                w = w - basis[rep] @ (basis[rep].T @ w)
            left, s, _ = np.linalg.svd(w, full_matrices=False)
            fresh = left[:, s > 1e-12 * max(np.abs(values).max(), 1e-300)]
            if not fresh.shape[1] or rep in before and np.abs(now - before[rep]).max(initial=0) <= TOLERANCE * max(now.max(initial=0), 1e-300):
                out[rep] = basis[rep] @ vectors[:, top]
                del newest[rep]
            else:
                newest[rep] = fresh
            before[rep] = now
        if not newest:
            return out
    raise RuntimeError(f"no convergence in {PASSES} passes")


def singular(rows: DataFrame, width: int, k: int, replicates: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The first k singular values of a matrix_rows() matrix and of `replicates` copies of it, each of whose rows is permuted (a row each, the matrix
    itself first); its right singular vectors (columns x k, of each the first of its largest entries positive); and the sum of its squares, which permutations leave."""
    k = min(k, width)
    values, right = [], np.zeros((width, 0))
    everything = [-1, *range(replicates)]
    squares = 0.0
    for lo in range(0, len(everything), REPLICATES):
        part = everything[lo : lo + REPLICATES]
        if width <= EXACT:
            ranges = dict.fromkeys(part, np.eye(width))
        else:
            ranges = _ranges(rows, width, part, k)
        triangles = _fold(rows, width, part, lambda rep, block: _triangle(block @ ranges[rep]), _stacked)  # noqa: B023
        for rep in part:
            s, vt = np.linalg.svd(triangles[rep])[1:] if rep in triangles else (np.zeros(0), np.zeros((0, width)))
            values.append(np.pad(s[:k], (0, max(0, k - len(s)))))
            if rep < 0 and len(vt):
                right = ranges[rep] @ vt[: min(k, len(s))].T
    if len(right.T):
        squares = float(_fold(rows, width, [-1], lambda _, block: (block * block).sum(), np.add).get(-1, 0.0))
        right = right * np.array([sign_of(c) for c in right.T])
    return np.array(values).reshape(-1, k), right, squares


def sign_of(vector: np.ndarray) -> float:
    """The sign of the first entry that is as large as the largest but for rounding; 1 for an empty or zero vector."""
    size = np.abs(vector)
    return float(np.sign(vector[np.argmax(size >= size.max() * (1 - 1e-6))])) or 1.0 if len(vector) else 1.0


def left_scores(rows: DataFrame, right: np.ndarray, kind: str) -> DataFrame:
    """(row, component, score): each row's product with every right singular vector; over the singular value it is the left vector's entry."""
    width, k = right.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("row")
            for lo, (own, block) in zip(range(0, b.num_rows, max(1, CELLS // max(1, width))), _blocks([b], width)):
                at = pa.array(np.repeat(np.arange(len(own)), k) + lo)
                yield pa.RecordBatch.from_arrays([names.take(at), pa.array(np.tile(np.arange(k, dtype=np.int32), len(own))), pa.array((block @ right).ravel())], ["row", "component", "score"])

    return rows.mapInArrow(run, f"row {kind}, component int, score double")
