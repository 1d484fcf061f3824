"""Choice of columns and penalties from sums of products: subsets by the sweep operator, lasso with cross-validation and stability, stacks, rank.

The rows are read once, into a table of moments by group: sums of the products of 1, the columns and y. Moments add up, so every fold,
half-sample and left-out group is a sum or a difference of them. The groups' moments stay a table; what reaches the driver is one matrix of columns x columns for
a fold, a replicate or the whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .linear import lasso_weights
from .nested import HELD, fits, scores
from .numbering import hash_ranks


def moment_table(data: DataFrame, keys: list[str], columns: list[str], y: str) -> DataFrame:
    """(keys, m): the upper triangle, row by row, of the sums of products of 1, the columns and y of each key's rows. Rows with a NULL or NaN among them are left out."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in [*columns, y])]
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in [*columns, y]]
    rows = data.select(*keys, *(e.alias(f"_{k}") for k, e in enumerate(x)), F.array(*whole).alias("_whole")).where(F.forall("_whole", lambda w: w))
    return rows.groupBy(*keys).agg(F.array(*(F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i, j in itertools.combinations_with_replacement(range(len(x)), 2))).alias("m"))


def square(m: Iterable[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = np.asarray(m, np.float64)
    return out + np.triu(out, 1).T


def summed(moments: DataFrame, keys: list[str], size: int) -> dict:
    """Moments added up by keys, as matrices: one for each value of the keys reaches the driver."""
    rows = moments.select(*keys, F.posexplode("m").alias("p", "x")).groupBy(*keys, "p").agg(F.sum("x").alias("x"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("v")).select(*keys, F.col("v.x").alias("x"))
    return {tuple(r[k] for k in keys): square(r["x"], size) for r in listed.collect() if r["x"]}


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means, and sums of squares and products about the means, of the columns and y."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] - n * np.outer(mean, mean)


def _spread(n: float, mean: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Deviations of the columns; 0 where a column is constant but for rounding."""
    sd = np.sqrt(np.maximum(np.diag(c)[:-1] / n, 0))
    return np.where(sd > 1e-12 * np.maximum(1, np.abs(mean[:-1])), sd, 0.0)


def sweep(a: np.ndarray, k: int, least: float = 1e-12) -> np.ndarray:
    """The matrix swept on k: column k joins the regression of the last row. Sweeping twice gives the matrix back, so a column is dropped as it was added.
    A column that others determine (its pivot is next to 0) stays out."""
    d = a[k, k]
    if abs(d) <= least:
        return a
    out = a - np.outer(a[:, k], a[k]) / d
    out[k], out[:, k] = a[k] / abs(d), a[:, k] / abs(d)
    out[k, k] = -1 / d
    return out


class Subsets:
    """Scores of column subsets, by bit mask: the mean over groups of the correlation of out-of-fold ridge predictions with y.

    data: group, fold (a group is in one fold), columns and y. Fold f's weights come from the moments of all other folds, its groups' scores from their own
    moments; each mask is scored once, however often it is asked for, and all new masks of a call in one job.
    """

    def __init__(self, data: DataFrame, group: str, fold: str, columns: list[str], y: str, alpha: float):
        self.columns, self.alpha = columns, alpha
        self.moments = cut(moment_table(data, [group, fold], columns, y).withColumnsRenamed({group: "group", fold: "fold"}))
        size = len(columns) + 2
        own = {k[0]: m for k, m in summed(self.moments, ["fold"], size).items()}
        self.bases = {f: self._base(sum(own.values()) - m) for f, m in own.items() if len(own) > 1}
        self.known: dict[int, tuple[float, float]] = {}

    def _base(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is swept: correlations of the standardised columns with the penalty, y in the last row; and the deviations."""
        n, mean, c = centred(m)
        sd = _spread(n, mean, c)
        scale = np.append(np.where(sd > 0, sd, np.inf), 1.0)
        a = c / np.outer(scale, scale)
        a[np.arange(len(sd)), np.arange(len(sd))] += np.where(sd > 0, self.alpha, 0.0)
        return a / n, sd

    def _weights(self, base: tuple[np.ndarray, np.ndarray], masks: list[int]) -> np.ndarray:
        """Weights on raw columns. A mask is reached from the last one by the columns in which they differ."""
        a, sd = base
        now, held, whole, out = a, 0, True, np.zeros((len(masks), len(sd)))
        for row, mask in enumerate(masks):
            changes = [k for k in range(len(sd)) if (mask ^ held) >> k & 1]
            if len(changes) > mask.bit_count() or not whole:
                now, changes = a, [k for k in range(len(sd)) if mask >> k & 1]
            whole = True
            for k in changes:
                before, now = now, sweep(now, k)
                whole &= before is not now  # a column that stayed out may have to come in later: then it starts anew
            held = mask
            inside = np.array([mask >> k & 1 == 1 and sd[k] > 0 and now[k, k] < 0 for k in range(len(sd))])
            out[row, inside] = now[: len(sd), -1][inside] / sd[inside]
        return out

    def scores(self, masks: Iterable[int]) -> dict[int, tuple[float, float]]:
        """(mean, standard error over groups) of each mask."""
        masks = list(dict.fromkeys(masks))
        new = sorted((m for m in masks if m not in self.known), key=lambda m: m ^ m >> 1)
        if new and self.bases:
            weights = {f: self._weights(b, new) for f, b in self.bases.items()}
            size = len(self.columns) + 2

            def run(batches):
                for b in batches:
                    out = []
                    for fold, m in zip(b["fold"], b["m"]):
                        c = centred(square(m, size))[2]
                        out.append(pd.DataFrame({"mask": range(len(new)), "r": scores(np.broadcast_to(c, (len(new), *c.shape)), weights[fold])}))
                    yield pd.concat(out) if out else pd.DataFrame({"mask": [], "r": []})

            rows = self.moments.select("fold", "m").mapInPandas(run, "mask int, r double").groupBy("mask").agg(F.avg("r").alias("mean"), F.coalesce(F.stddev_samp("r") / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"))
            for r in rows.collect():  # a row a mask
                self.known[new[r.mask]] = (r["mean"], r["se"])
        return {m: self.known[m] for m in masks if m in self.known}

    def single_and_drop_one(self) -> list[tuple[str, float, float, float]]:
        """(column, its score alone, the full score, the full score less that without it)."""
        full = (1 << len(self.columns)) - 1
        found = self.scores([full, *(1 << k for k in range(len(self.columns))), *(full ^ 1 << k for k in range(len(self.columns)))])
        return [(c, found[1 << k][0], found[full][0], found[full][0] - found[full ^ 1 << k][0]) for k, c in enumerate(self.columns)] if found else []

    def path(self, forward: bool = True, tie: float = 1e-12) -> list[tuple[int, str, float]]:
        """(size, column, score): greedy. Forward adds the column that scores best with the others (ties: first by name); backward, from all columns,
        drops the one whose removal leaves the best score (ties: last by name), down to one column, and names it with the score of what is left."""
        now, out = (0 if forward else (1 << len(self.columns)) - 1), []
        if not self.bases:
            return out
        while (now.bit_count() < len(self.columns)) if forward else (now.bit_count() > 1):
            tries = {c: now ^ 1 << k for k, c in enumerate(self.columns) if (now >> k & 1) != forward}
            found = self.scores(tries.values())
            best = max(found[m][0] for m in tries.values())
            equal = [c for c, m in tries.items() if found[m][0] >= best - tie]
            column = min(equal) if forward else max(equal)
            now = tries[column]
            out.append((now.bit_count(), column, found[now][0]))
        return out


def lasso_grid(m: np.ndarray, count: int = 30, ratio: float = 1e-3) -> np.ndarray:
    """Penalties from the smallest that leaves no column, falling evenly in logarithms."""
    n, mean, c = centred(m)
    sd = _spread(n, mean, c)
    top = float(np.abs(c[:-1, -1] / np.where(sd > 0, sd, np.inf) / n).max(initial=0)) or 1.0
    return top * np.logspace(0, np.log10(ratio), count)


def lasso_fit(m: np.ndarray, grid: np.ndarray, sd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights on standardised columns for each penalty of a falling grid, each starting from the one before; the deviations). sd: deviations to standardise by, if not those of m."""
    n, mean, c = centred(m)
    sd = _spread(n, mean, c) if sd is None else sd
    scale = np.where(sd > 0, sd, np.inf)
    g, b = c[:-1, :-1] / np.outer(scale, scale) / n, c[:-1, -1] / scale / n
    w, out = None, []
    for lam in grid:
        w = lasso_weights(g, b, lam, 5000, start=w)
        out.append(w)
    return np.array(out), sd


def lasso_cv(data: DataFrame, fold: str, columns: list[str], y: str, count: int = 30, ratio: float = 1e-3) -> tuple[list[tuple[float, float]], int, np.ndarray]:
    """([(penalty, mean squared error)], place of the chosen one, moments of all rows). Each fold is predicted by a fit on the others, standardised
    by the others; errors are averaged over the folds, and of equal ones the larger penalty is chosen."""
    return _cv(moment_table(data, [fold], columns, y), fold, columns, count, ratio)


def _cv(moments: DataFrame, fold: str, columns: list[str], count: int, ratio: float) -> tuple[list[tuple[float, float]], int, np.ndarray]:
    own = summed(moments, [fold], len(columns) + 2)
    if not own:
        return [], 0, np.zeros((len(columns) + 2,) * 2)
    total = sum(own.values())
    grid = lasso_grid(total, count, ratio)
    errors = np.zeros(len(grid))
    for m in own.values():
        rest = total - m
        if len(own) == 1 or rest[0, 0] <= 0:
            rest = total
        w, sd = lasso_fit(rest, grid)
        raw = w / np.where(sd > 0, sd, np.inf)
        mean = rest[0, 1:] / rest[0, 0]
        intercept = mean[-1] - raw @ mean[:-1]
        full = np.column_stack([-intercept, -raw, np.ones(len(grid))])  # y less the prediction
        errors += np.einsum("gi,ij,gj->g", full, m, full) / m[0, 0] / len(own)
    return [(float(a), float(e)) for a, e in zip(grid, errors)], int(np.argmin(errors)), total


def half_samples(groups: DataFrame, replicates: int) -> DataFrame:
    """(replicate, group): the half, rounded down, of the groups with the smallest hashes, for each replicate."""
    n = groups.count()
    rows = groups.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    ranked = hash_ranks(rows, ["replicate"], F.sha2(F.concat_ws(":", F.col("replicate").cast("string"), F.col("group").cast("string")), 256), "place")
    return ranked.where(F.col("place") <= n // 2).select("replicate", "group")


def lasso_stability(data: DataFrame, group: str, fold: str, columns: list[str], y: str, replicates: int = 50, count: int = 30) -> DataFrame:
    """(place, column, frequency, magnitude, penalty): how often a lasso at the penalty that lasso_cv() chooses keeps each column in halves of the groups, and
    its mean absolute weight there; by frequency, then magnitude, then name. The halves' columns are scaled by the deviations over all rows."""
    spark = data.sparkSession
    schema = "place int, column string, frequency double, magnitude double, penalty double"
    moments = cut(moment_table(data, [group, fold], columns, y).withColumnsRenamed({group: "group", fold: "fold"}))
    grid, k, total = _cv(moments, "fold", columns, count, 1e-3)
    if not grid:
        return spark.createDataFrame([], schema)
    sd = _spread(*centred(total))
    halves = summed(half_samples(moments.select("group").distinct(), replicates).join(moments, "group"), ["replicate"], len(columns) + 2)
    path = np.array([a for a, _ in grid[: k + 1]])
    weights = np.array([lasso_fit(m, path, sd)[0][-1] for m in halves.values()]).reshape(-1, len(columns))
    kept, size = (np.abs(weights) > 1e-12).sum(0) / max(len(halves), 1), np.abs(weights).mean(0) if len(weights) else np.zeros(len(columns))
    order = sorted(range(len(columns)), key=lambda c: (-kept[c], -round(size[c], 12), columns[c]))
    return spark.createDataFrame([(p, columns[c], round(float(kept[c]), 6), round(float(size[c]), 6), round(grid[k][0], 9)) for p, c in enumerate(order, 1)], schema)


def stacks(data: DataFrame, group: str, columns: list[str], y: str, alphas: list[float]) -> DataFrame:
    """(group, alpha, r): every group predicted by a ridge stack of the columns fitted on the others, whose penalty is chosen among these: each of them left out of
    the fit in turn, the penalty with the highest mean correlation wins (rounded at 12 places; of equal ones the first). NULL where fewer than two others are left.

    A pair of left-out groups is the total less their moments. A task takes some held-out groups and the moments of all.
    """
    size = len(columns) + 2
    moments = cut(moment_table(data, [group], columns, y).withColumnRenamed(group, "group"))
    kind = moments.schema["group"].dataType.simpleString()
    parts = moments.count() // HELD + 1
    whole = sum(summed(moments, [], size).values())
    every = moments.select(F.col("group").alias("name"), "m", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    mine = moments.select("group", F.pmod(F.xxhash64("group"), F.lit(parts)).cast("int").alias("part"))

    def run(held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = rows["name"].tolist()
        m = np.array([square(x, size) for x in rows["m"]]).reshape(-1, size, size)
        c = np.array([centred(x)[2] for x in m])
        out = []
        for g in held["group"]:
            i = names.index(g)
            others = np.array([k for k in range(len(names)) if k != i])
            if len(others) < 2:
                out.append((g, None, None))
                continue
            best = None
            for alpha in alphas:
                w = fits(whole - m[i] - m[others], alpha)[0]
                score = round(float(scores(c[others], w).mean()), 12)
                if best is None or score > best[0]:
                    best = (score, alpha)
            w = fits((whole - m[i])[None], best[1])[0]
            out.append((g, best[1], round(float(scores(c[i][None], w)[0]), 6)))
        return pd.DataFrame(out, columns=["group", "alpha", "r"])

    return mine.groupBy("part").cogroup(every.groupBy("part")).applyInPandas(run, f"group {kind}, alpha double, r double")


def pivoted_cholesky(a: np.ndarray, least: float) -> tuple[list[int], np.ndarray]:
    """Pivots of a positive semidefinite matrix, largest first, down to `least`, and the order in which its columns were taken."""
    a, order, pivots = a.astype(np.float64).copy(), [], []
    free = np.ones(len(a), bool)
    while free.any():
        k = int(np.where(free, np.diag(a), -np.inf).argmax())
        if a[k, k] <= least:
            break
        pivots.append(float(a[k, k]))
        order.append(k)
        free[k] = False
        a = a - np.outer(a[:, k], a[k]) / a[k, k]
    return order, np.array(pivots)


def column_rank(data: DataFrame, columns: list[str]) -> DataFrame:
    """(n_columns, n_constant, rank, effective_rank, condition, independent): of the standardised columns that are not constant: the number of pivots of their
    correlation matrix above rounding, the participation ratio of its eigenvalues, the ratio of the largest to the smallest (NULL if singular), and a largest
    set of columns that do not depend on each other, in the order of pivots."""
    spark = data.sparkSession
    schema = "n_columns int, n_constant int, rank int, effective_rank double, condition double, independent array<string>"
    means = data.agg(*(F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in columns)).head()
    about = data.select(*((F.col(c).cast("double") - F.lit(means[c] or 0.0)).alias(c) for c in columns))  # sums about the means keep their places
    moments = moment_table(about, [], columns, columns[0])
    m = square(moments.head()["m"], len(columns) + 2)
    if not m[0, 0] > 0:  # NULL without rows
        return spark.createDataFrame([(len(columns), len(columns), 0, 0.0, None, [])], schema)
    n, _, c = centred(m)
    sd = _spread(n, np.array([*(means[x] or 0.0 for x in columns), 0.0]), c)
    live = np.flatnonzero(sd > 0)
    r = c[np.ix_(live, live)] / n / np.outer(sd[live], sd[live])
    order, pivots = pivoted_cholesky(r, 1e-10 * max(len(live), 1))
    values = np.clip(np.linalg.eigvalsh(r), 0, None) if len(live) else np.zeros(0)
    effective = float(values.sum() ** 2 / (values**2).sum()) if (values**2).sum() > 0 else 0.0
    singular = len(order) < len(live) or not len(live)
    row = (len(columns), len(columns) - len(live), len(order), round(effective, 6), None if singular else round(float(values.max() / values.min()), 4), [columns[live[k]] for k in order])
    return spark.createDataFrame([row], schema)
