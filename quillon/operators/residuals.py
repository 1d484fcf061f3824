"""What a prediction leaves: its singular components against permuted residuals, and who loads on them.

The matrix has a row a measure, spread over the executors, and a column a group; each replicate permutes every measure's residuals
over the groups, which stays within a row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import factor


def _matrix(rows: DataFrame, pred: str, truth: str) -> tuple[DataFrame, list]:
    return factor.matrix_rows(rows.select("pert", "gene", (F.col(truth) - F.col(pred)).alias("residual")), "gene", "pert", "residual")


def residual_spectrum(rows: DataFrame, pred: str, truth: str, replicates: int = 99, most: int = 25) -> DataFrame:
    """(component, value, null_p95, p): the largest singular values of the residuals, at most `most`, against those of the replicates;
    p = (1 + replicates at least as large) / (1 + replicates)."""
    matrix, groups = _matrix(rows, pred, truth)
    k = min(most, matrix.count(), len(groups))
    values, _, _ = factor.singular(matrix, len(groups), k, replicates) if k else (np.zeros((1 + replicates, 0)),) * 3
    seen, null = values[0], values[1:]
    out = [(c, round(float(seen[c]), 6), round(float(np.percentile(null[:, c], 95)), 6), round((1 + int((null[:, c] >= seen[c] * (1 - 1e-12)).sum())) / (1 + replicates), 6)) for c in range(k)]
    return rows.sparkSession.createDataFrame(out, "component int, value double, null_p95 double, p double")  # a row a component


def residual_structure(rows: DataFrame, pred: str, truth: str, k: int = 5, replicates: int = 5) -> DataFrame:
    """(component, share, null_share, null_min, null_max, cumulative, top_group_share, low_rank): each component's share of the residuals' squares and its
    mean, least and largest share in the replicates; the part of a component's group scores that its largest group holds, which tells one badly
    predicted group from a program that many share; low_rank: the first share is more than twice its mean in the replicates."""
    matrix, groups = _matrix(rows, pred, truth)
    k = min(k, matrix.count(), len(groups))
    if not k:
        return rows.sparkSession.createDataFrame([], "component int, share double, null_share double, null_min double, null_max double, cumulative double, top_group_share double, low_rank boolean")
    values, right, squares = factor.singular(matrix, len(groups), k, replicates)
    share = values**2 / squares if squares > 0 else np.zeros_like(values)
    seen, null = share[0], share[1:]
    low = bool(seen[0] > 2 * null[:, 0].mean())
    columns = [seen, null.mean(0), null.min(0), null.max(0), np.cumsum(seen), (right**2).max(0) if right.shape[1] == k else np.zeros(k)]
    out = [(c + 1, *(round(float(x[c]), 6) for x in columns), low) for c in range(k)]
    return rows.sparkSession.createDataFrame(out, "component int, share double, null_share double, null_min double, null_max double, cumulative double, top_group_share double, low_rank boolean")


def residual_loadings(rows: DataFrame, pred: str, truth: str, components: int = 2, top: int = 10) -> DataFrame:
    """(component, side, place, name, loading): the measures (entries of the unit vector) and groups (scores: entry times singular value) with the largest loadings of each component,
    ties by name. The first of the largest group entries is positive. Measures' loadings stay on the executors; only the report is small."""
    spark = rows.sparkSession
    matrix, groups = _matrix(rows, pred, truth)
    k = min(components, matrix.count(), len(groups))
    schema = "component int, side string, place int, name string, loading double"
    if not k:
        return spark.createDataFrame([], schema)
    values, right, _ = factor.singular(matrix, len(groups), k)
    live = [c for c in range(right.shape[1]) if values[0, c] > 0]
    scores = []
    for c in live:
        order = sorted(range(len(groups)), key=lambda g: (-round(abs(right[g, c]), 9), groups[g]))[:top]  # noqa: B023
        scores += [(c + 1, "group", place, str(groups[g]), round(float(right[g, c] * values[0, c]), 6)) for place, g in enumerate(order, 1)]
    entries = factor.left_scores(matrix, right[:, live] / values[0, live], rows.schema["gene"].dataType.simpleString())
    parts = [spark.createDataFrame(scores, schema)]
    for at, c in enumerate(live):
        best = entries.where(F.col("component") == at).select(F.col("row").cast("string").alias("name"), F.round("score", 6).alias("loading"))
        best = best.orderBy(F.desc(F.abs("loading")), "name").limit(top)  # the report's length
        order = F.array_sort(F.collect_list(F.struct((-F.abs("loading")).alias("o"), "name", "loading")))
        parts.append(best.agg(order.alias("m")).select(F.lit(c + 1).alias("component"), F.lit("measure").alias("side"), F.posexplode("m").alias("p", "m")).select("component", "side", (F.col("p") + 1).cast("int").alias("place"), "m.name", "m.loading"))
    return reduce(DataFrame.unionByName, parts)
