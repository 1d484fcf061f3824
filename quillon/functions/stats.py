"""Statistics as column expressions, for groupBy().agg() and windows."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation that is 0 when either side is constant, never NULL or NaN for n >= 1."""
    spread = F.var_pop(x) * F.var_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / F.sqrt(spread)).otherwise(F.lit(0.0))


def r_squared(truth: Column, pred: Column) -> Column:
    """1 - SSE / SST, 0 when SST is 0."""
    sst = F.var_pop(truth) * F.count(truth)
    return F.when(sst > 0, 1 - F.sum((truth - pred) * (truth - pred)) / sst).otherwise(F.lit(0.0))


def rmse(truth: Column, pred: Column) -> Column:
    return F.sqrt(F.avg((truth - pred) * (truth - pred)))


def sd_or_zero(x: Column) -> Column:
    """Sample standard deviation, 0 for one value, NULL for none."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def mid_rank(order: WindowSpec, ties: WindowSpec) -> Column:
    """Average rank: rank() over order, plus half of the other rows of the same value."""
    return F.rank().over(order).cast("double") + (F.count("*").over(ties).cast("double") - 1) / 2


def benjamini_hochberg(p: Column, rank: Column, n: Column, descending: WindowSpec) -> Column:
    """Adjusted p: running minimum of p n / rank from the largest p down, at most 1."""
    return F.least(F.lit(1.0), F.min(p * n / rank).over(descending))


def holm(p: Column, rank: Column, n: Column, ascending: WindowSpec) -> Column:
    """Step-down adjusted p: running maximum of (n - rank + 1) p, at most 1; rank from 1."""
    return F.max(F.least(F.lit(1.0), (n - rank + 1) * p)).over(ascending)


def spearman_brown(r: Column, k: float) -> Column:
    den = 1 + (k - 1) * r
    return F.when(den > 0, k * r / den).otherwise(F.lit(-1.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share."""
    p = k / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    den = 1 + z * z / n
    return (mid - half) / den, (mid + half) / den


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal, by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    #: The coefficients of the approximation.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def verdict(gain: Column, se: Column, wins: Column, n: Column) -> Column:
    """'a' or 'b' when the mean gain exceeds twice its error and most pairs agree; 'none'; NULL below three pairs."""
    return F.when(n < 3, F.lit(None).cast("string")).when((gain > 2 * se) & (wins > n / 2), "a").when((-gain > 2 * se) & (wins < n / 2), "b").otherwise("none")


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series eight places on (error below 1e-12)."""
    y = x.cast("double") + 8
    below = F.lit(0.0)
    for k in range(8):
        below = below + F.log(x.cast("double") + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - below


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
