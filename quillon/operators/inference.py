"""Student's t without a statistics library, and rules built on it."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            step = 1.0
        elif k % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d)
        c = 1 + step / c
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (out - 1)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for 0.5 < p < 1, by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def welch(samples: DataFrame, key: str, side: str, value: str) -> DataFrame:
    """(key, t, df, p) of the sides 'a' and 'b' of each key; NULL where a side has fewer than two values."""
    moments = []
    for s in "ab":
        x = F.when(F.col(side) == s, F.col(value))
        moments += [F.count(x).alias(f"n{s}"), F.avg(x).alias(f"m{s}"), F.var_samp(x).alias(f"v{s}")]
    g = samples.groupBy(key).agg(*moments)

    def test(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                a, c = r.va / r.na if r.na > 1 else None, r.vb / r.nb if r.nb > 1 else None
                if a is None or c is None or a + c <= 0:
                    rows.append((getattr(r, key), None, None, None))
                    continue
                t, df = (r.ma - r.mb) / math.sqrt(a + c), (a + c) ** 2 / (a * a / (r.na - 1) + c * c / (r.nb - 1))
                rows.append((getattr(r, key), round(t, 6), round(df, 6), round(t_two_sided(t, df), 8)))
            yield pd.DataFrame(rows, columns=[key, "t", "df", "p"])

    kind = samples.schema[key].dataType.simpleString()
    return g.mapInPandas(test, f"{key} {kind}, t double, df double, p double")


def arm_rule(runs: DataFrame, key: str, n: int) -> DataFrame:
    """Verdict over the runs of an arm: rows (key, g, s, wins_a, wins_b, pairs).

    Mean gain G and mean error S; the error of the arm adds the spread of the gains over runs. The bound is two errors or, where
    the Welch-Satterthwaite degrees of freedom ask for more, the 0.975 quantile of t. All runs must agree in sign, and most pairs be won.
    """
    a = runs.groupBy(key).agg(
        F.count("*").alias("R"), F.avg("g").alias("G"), F.avg("s").alias("S"), F.coalesce(F.stddev_samp("g"), F.lit(0.0)).alias("sd"),
        F.min("g").alias("least"), F.max("g").alias("most"), F.sum("wins_a").alias("wa"), F.sum("wins_b").alias("wb"), F.sum("pairs").alias("total"),
    )

    def judge(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                spread = r.sd**2 / r.R if r.R > 1 else 0.0
                se = math.sqrt(r.S**2 + spread)
                den = (r.S**4 / (n - 1) if n > 1 else 0.0) + (spread**2 / (r.R - 1) if r.R > 1 else 0.0)
                k = max(2.0, t_quantile(0.975, se**4 / den)) if den > 0 else 2.0
                up = r.G > k * se and r.least > 0 and r.wa > r.total / 2
                down = -r.G > k * se and r.most < 0 and r.wb > r.total / 2
                rows.append((getattr(r, key), r.R, round(r.G, 6), round(se, 6), round(k, 6), "a" if up else "b" if down else "none"))
            yield pd.DataFrame(rows, columns=[key, "runs", "gain", "se", "k", "verdict"])

    kind = runs.schema[key].dataType.simpleString()
    return a.mapInPandas(judge, f"{key} {kind}, runs long, gain double, se double, k double, verdict string")
