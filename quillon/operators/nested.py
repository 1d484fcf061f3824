"""Nested leave-one-out of a stack from inner products of groups, without their matrix.

Every sum that a fold needs is a sum of products of groups' profiles: the mean of the free groups is the total less the groups that
are apart, and the neighbours' mean holds a few profiles. So a fold's moments are those of all groups, downdated by the inner products of the groups that it leaves out
(rank-one downdates), and a held-out pair costs the square of these few groups, not a pass over the measures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .linear import group_products

#: Held-out groups of a task.
HELD = 64


def fits(m: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights on raw columns and the columns' covariances with each other and y, for moments (folds x (columns + 2) squared) of ridge on standardised columns."""
    n = m[:, 0, 0][:, None]
    mean = m[:, 0, 1:] / n
    c = m[:, 1:, 1:] - n[:, :, None] * mean[:, :, None] * mean[:, None, :]
    p = m.shape[1] - 2
    sd = np.sqrt(np.maximum(np.diagonal(c, axis1=1, axis2=2)[:, :p] / n, 0))
    live = sd > 1e-12 * np.maximum(1, np.abs(mean[:, :p]))
    sd = np.where(live, sd, 1.0)
    g = c[:, :p, :p] / (sd[:, :, None] * sd[:, None, :]) * (live[:, :, None] & live[:, None, :])
    b = c[:, :p, p] / sd * live
    return np.linalg.solve(g + alpha * np.eye(p), b[:, :, None])[:, :, 0] / sd, c


def scores(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Correlation of the columns' mix by w with y from their covariances; 0 where a side is constant but for rounding."""
    p = c.shape[1] - 1
    cov = np.einsum("fp,fp->f", w, c[:, :p, p])
    var = np.einsum("fp,fpq,fq->f", w, c[:, :p, :p], w)
    size = np.einsum("fp,fp->f", w * w, np.diagonal(c, axis1=1, axis2=2)[:, :p])
    good = (var > 1e-12 * np.maximum(size, 1e-300)) & (c[:, p, p] > 0)
    return np.where(good, cov / np.sqrt(np.where(good, var * c[:, p, p], 1.0)), 0.0)


class _Fold:
    """A group with those apart from it, its nearest, and the inner products among all these."""

    def __init__(self, row):
        self.q, self.z = row.q, np.asarray(row.z)
        self.at = {z: k for k, z in enumerate(self.z.tolist())}
        size = len(self.z)
        self.g = np.asarray(row.g, np.float64).reshape(size, size)
        self.r, self.s = np.asarray(row.r, np.float64), np.asarray(row.s, np.float64)
        self.apart = [z for z, a in zip(self.z.tolist(), row.apart) if a]
        weight = {z: w for z, w in zip(self.z.tolist(), row.w) if w is not None and w > 0}
        self.near = sorted(weight, key=lambda z: (-weight[z], z))
        self.weight = weight


def pair_moments(fold: _Fold, out: dict, total: tuple[int, int, float, float], k: int) -> np.ndarray | None:
    """Moments of 1, the mean of the free groups, the mean of the k nearest of them and fold.q itself, where the groups of `out` are apart beside its own.

    out: for every group also apart its products with all groups, its row sum and its sum. None where no group is free.
    """
    groups, measures, all_products, all_sum = total
    more = {e: x for e, x in out.items() if e not in fold.apart}
    own = [fold.at[e] for e in fold.apart]
    free = groups - len(own) - len(more)
    if free <= 0:
        return None
    rows = fold.r[own].sum() + sum(r for _, r, _ in more.values())
    inner = fold.g[np.ix_(own, own)].sum()
    for e, (products, _, _) in more.items():
        inner += 2 * sum(products.get(a, 0.0) for a in fold.apart) + sum(products.get(o, 0.0) for o in more)
    with_free = fold.r - fold.g[:, own].sum(1) - np.array([sum(x[0].get(z, 0.0) for x in more.values()) for z in fold.z.tolist()])
    q = fold.at[fold.q]
    near = [z for z in fold.near if z not in more][:k]
    m = np.zeros((4, 4))
    m[0, 0], m[0, 3], m[3, 3] = measures, fold.s[q], fold.g[q, q]
    m[0, 1] = (all_sum - fold.s[own].sum() - sum(s for _, _, s in more.values())) / free
    m[1, 1], m[1, 3] = (all_products - 2 * rows + inner) / free**2, with_free[q] / free
    if near:
        at = [fold.at[z] for z in near]
        a = np.array([fold.weight[z] for z in near])
        a /= a.sum()
        m[0, 2], m[2, 2], m[1, 2], m[2, 3] = a @ fold.s[at], a @ fold.g[np.ix_(at, at)] @ a, a @ with_free[at] / free, a @ fold.g[at, q]
    else:
        m[0, 2], m[2, 2], m[1, 2], m[2, 3] = m[0, 1], m[1, 1], m[1, 1], m[1, 3]
    return np.triu(m) + np.triu(m, 1).T


def nested_loo(delta: DataFrame, similarity: DataFrame, alphas: list[float], k: int = 5, hidden: DataFrame | None = None) -> DataFrame:
    """(pert, alpha, r, r_mean, r_neighbours): every group held out once, predicted by a ridge stack of two columns: the mean response of the free
    groups, and that of its k nearest by their weight.

    The penalty is chosen among the other groups, each left out of the fit and of the columns in turn, by their mean
    correlation; of equal ones the first. A held-out group, and the groups that hidden (pert, other) names for it, have no
    part in any column, fit or choice of its own. similarity: (a, b, w) of groups, both orders. Cells that are missing count as 0.
    A group that leaves no other to learn from has NULLs.

    A task takes some held-out groups with their products with all groups, and the folds of all groups, each of which holds the products
    of its neighbours and its hidden groups among each other.
    """
    kind = delta.schema["pert"].dataType.simpleString()
    delta = cut(delta.select("pert", "gene", "delta"))
    x = F.col("delta").cast("double")
    known = cut(delta.groupBy("pert").agg(F.coalesce(F.sum(F.when(~F.isnan(x), x)), F.lit(0.0)).alias("s")))
    n = known.count()
    if n < 3:
        raise ValueError("three groups are the least to leave one out")
    measures = delta.agg(F.count_distinct("gene").alias("n")).head().n
    products = cut(group_products(delta))
    row_sums = products.groupBy(F.col("p").alias("pert")).agg(F.sum("k").alias("r"))
    sums = cut(known.join(row_sums, "pert", "left").select("pert", "s", F.coalesce("r", F.lit(0.0)).alias("r")))
    whole = sums.agg(F.sum("r").alias("r"), F.sum("s").alias("s")).head()
    total = (n, measures, whole.r, whole.s)

    apart = known.select("pert", F.col("pert").alias("z"))
    if hidden is not None:
        apart = apart.union(hidden.select("pert", "other")).distinct().join(known.select("pert"), "pert", "left_semi").join(known.select(F.col("pert").alias("z")), "z", "left_semi").select("pert", "z")
    apart = cut(apart)
    most = apart.groupBy("pert").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).head().n
    # However many of a group's nearest are apart from a held-out group, k of the others are among the first k + most.
    near = similarity.select(F.col("a").alias("q"), F.col("b").alias("z"), F.col("w").cast("double").alias("w")).where("w > 0")
    near = near.join(apart.select(F.col("pert").alias("q"), "z"), ["q", "z"], "left_anti").join(known.select(F.col("pert").alias("z")), "z", "left_semi").join(known.select(F.col("pert").alias("q")), "q", "left_semi")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("w"), "z"))).where(F.col("place") <= k + most)
    members = apart.select(F.col("pert").alias("q"), "z", F.lit(None).cast("double").alias("w"), F.lit(True).alias("apart")).unionByName(near.select("q", "z", "w", F.lit(False).alias("apart")))
    members = cut(members.join(sums.withColumnRenamed("pert", "z"), "z"))
    square = members.select("q", "z").join(members.select("q", F.col("z").alias("y")), "q")
    square = square.join(products.select(F.col("p").alias("z"), F.col("q").alias("y"), F.col("k").alias("g")), ["z", "y"], "left")
    inner = square.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("z", "y", F.coalesce("g", F.lit(0.0)).alias("g")))).alias("g"))  # few groups squared
    listed = members.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("z", "w", "apart", "r", "s"))).alias("m"))
    parts = n // HELD + 1
    folds = listed.join(inner, "q").select("q", *(F.col(f"m.{c}").alias(c) for c in ("z", "w", "apart", "r", "s")), F.col("g.g").alias("g"))
    folds = folds.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    part = F.pmod(F.xxhash64("pert"), F.lit(parts)).cast("int")
    held = apart.join(sums.withColumnRenamed("pert", "z"), "z").join(products.select(F.col("p").alias("z"), F.col("q").alias("y"), F.col("k").alias("g")), "z", "left")
    held = held.select(part.alias("part"), "pert", "z", "r", "s", "y", "g")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        by = {f.q: f for f in map(_Fold, right.itertuples())}
        out = []
        for i, own in left.groupby("pert"):
            gone = {}
            for e, x in own.groupby("z"):
                has = x["y"].notna()
                gone[e] = (dict(zip(x["y"][has], x["g"][has])), x["r"].iloc[0], x["s"].iloc[0])
            train = [m for q, f in by.items() if q not in gone and (m := pair_moments(f, gone, total, k)) is not None]
            mine = pair_moments(by[i], gone, total, k)
            if not train or mine is None:
                out.append((i, None, None, None, None))
                continue
            m = np.array(train)
            every = m.sum(0)
            best = None
            if len(m) > 1:
                at = [fits(m, 1.0)[1], every - m]  # covariances of each group's own columns, and the moments of the others
                for alpha in alphas:
                    score = round(float(scores(at[0], fits(at[1], alpha)[0]).mean()), 12)
                    if best is None or score > best[0]:
                        best = (score, alpha)
            alpha = best[1] if best else alphas[0]
            c = fits(mine[None], 1.0)[1]
            w = fits(every[None], alpha)[0]
            out.append((i, alpha, *(round(float(scores(c, v)[0]), 6) for v in (w, np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]])))))
        return pd.DataFrame(out, columns=["pert", "alpha", "r", "r_mean", "r_neighbours"])

    return held.groupBy("part").cogroup(folds.groupBy("part")).applyInPandas(run, f"pert {kind}, alpha double, r double, r_mean double, r_neighbours double")
