"""Exact nearest neighbours of whole tables of vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one side of a block: at least, and at most; numbers of one side of it at most.
BLOCK, MOST, NUMBERS = 512, 16384, 4 << 20
#: Parts that a table is cut into as long as its blocks stay under those limits.
PARTS = 16
#: Rows of a block that are multiplied at once.
STRIP = 256
#: More than the error of a product of two unit vectors.
SLACK = 1e-9


def cosine_neighbours(vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(a, b, s): the k nearest other rows of every row of vectors (id, x) by cosine, ties by id.

    Vectors are dealt to square blocks; a task multiplies the two matrices of one block in strips and passes on
    the k best of each of its rows, so rows grow with the blocks and not with the pairs. Blocks grow with the table up to a limit,
    so that every vector is sent to as few as PARTS blocks. A cosine is summed pair by pair in the end, so that equal vectors tie.
    Vectors that are NULL, zero or hold values that are not finite have no neighbours and are none.
    """
    good = F.col("x").isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0)
    rows = vectors.select("id", F.col("x").cast("array<double>").alias("x")).where(good)
    table = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).head()
    block = block or max(BLOCK, min(table.n // PARTS + 1, MOST, NUMBERS // (table.width or 1)))
    parts = table.n // block + 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.select("id", "x", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def floor(near: np.ndarray) -> np.ndarray:
        """A value for each column that k of its entries reach: the k-th largest of the maxima of runs of entries."""
        n, wide = near.shape
        if n < k:
            return np.full(wide, -2.0)
        runs = min(n, 8 * k)
        tops = near[: n // runs * runs].reshape(runs, n // runs, wide).max(axis=1)
        return np.maximum(np.partition(tops, runs - k, axis=0)[runs - k], -2.0)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["x"].tolist())
        m = m / np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        ids, part = pdf["id"].to_numpy(), pdf["part"].to_numpy()
        i, j = np.flatnonzero(part == pdf["i"].iloc[0]), np.flatnonzero(part == pdf["j"].iloc[0])
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        right, low = np.ascontiguousarray(m[j].T), np.full(len(j), -2.0)
        found = []
        for start in range(0, len(i) if len(j) else 0, STRIP):
            strip = i[start : start + STRIP]
            near = m[strip] @ right
            if same:
                near[ids[strip][:, None] == ids[j][None, :]] = -np.inf
            a, b = np.nonzero(near >= (floor(near.T) - SLACK)[:, None])
            found.append((strip[a], j[b]))
            if not same:
                low = np.maximum(low, floor(near))
                a, b = np.nonzero(near >= low - SLACK)
                found.append((j[b], strip[a]))
        if not found:
            return pd.DataFrame({"a": ids[:0], "b": ids[:0], "s": np.zeros(0)})
        a, b = (np.concatenate(c) for c in zip(*found))
        s = np.empty(len(a))
        for start in range(0, len(a), 1 << 16):
            at = slice(start, start + (1 << 16))
            s[at] = (m[a[at]] * m[b[at]]).sum(axis=1)
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        # The k-th value and its ties, so that the id decides.
        first = np.searchsorted(a, a, "left")
        last = np.minimum(first + k, np.searchsorted(a, a, "right")) - 1
        keep = s >= s[last]
        return pd.DataFrame({"a": ids[a[keep]], "b": ids[b[keep]], "s": s[keep]})

    kind = vectors.schema["id"].dataType.simpleString()
    near = rows.groupBy("i", "j").applyInPandas(multiply, f"a {kind}, b {kind}, s double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return near.withColumn("r", rank).where(F.col("r") <= k).drop("r")
