import math

import numpy as np
import pytest

from quillon.llm import whitening
from quillon.llm.whitening import COMPONENTS, axes, centred, fit, merge, summary, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, most=COMPONENTS):
    """By whole lists of Python integers and one matrix."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not good:
        return {}, None
    n, sums = len(good), [sum(c) for c in zip(*(x for _, x in good))]
    x = np.array([[c - s / n for c, s in zip(v, sums)] for _, v in good])
    v = x.T @ x / n
    values, vectors = np.linalg.eigh(v)
    order = [k for k in np.argsort(-values)[:most] if values[k] > 1e-12 * np.trace(v)]
    out = {}
    for (i, own), row in zip(good, x):
        deviation = sum((n * c - s) ** 2 for c, s in zip(own, sums))
        for number, k in enumerate(order, 1):
            out.setdefault((i, number), []).append((n, deviation, row @ vectors[:, k] / math.sqrt(values[k]), values[k] / np.trace(v)))
    return out, len(order)


def compare(got, rows):
    want, k = brute(rows)
    found = {}
    for r in got.collect():
        found.setdefault((r.vec_id, r.component), []).append(r)
    assert found.keys() == want.keys() and all(len(found[x]) == len(want[x]) for x in want)
    for number in range(1, (k or 0) + 1):
        sign = None
        for key in (x for x in want if x[1] == number):
            for r, (n, deviation, whitened, explained) in zip(sorted(found[key], key=lambda r: r.deviation), sorted(want[key])):
                assert (r.n, r.deviation) == (n, deviation)
                assert math.isclose(r.explained, explained, rel_tol=1e-9) and r.identity_error < 1e-9
                if sign is None and abs(whitened) > 1e-3:
                    sign = math.copysign(1, whitened * r.whitened)
                assert abs(r.whitened - (sign or 1) * whitened) < 1e-7


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) + rng.standard_normal(d) * 5).astype(np.float32)


@pytest.mark.parametrize("n, d", [(300, 40), (20, 30), (500, 3)])
def test_equals_the_whole_matrix(spark, n, d):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors(n, d, n))]
    compare(whiten(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(7)), rows)


def test_odd_rows(spark):
    v = [[float(c) for c in r] for r in vectors(40, 4, 2)]
    rows = [*enumerate(v), (50, None), (51, []), (52, [1.0, None, 2.0, 3.0]), (53, [math.nan] * 4), (54, [math.inf, 1.0, 1.0, 1.0]), (None, v[3]), (3, v[3]), (55, [3.0e38, 1.0, 1.0, 1.0]), (56, [1.0] * 5)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    compare(whiten(frame.withColumn("component", frame.vec_id).withColumn("state", frame.label)), [r for r in rows if r[0] not in (55, 56)])


def test_tables_without_variance(spark):
    empty = whiten(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(9)], SCHEMA)).count() == 0
    # A constant dimension beside one with variance.
    assert {r.component for r in whiten(spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(9)], SCHEMA)).collect()} == {1}


def test_merging_in_any_order_gives_the_same_moments():
    rng = np.random.default_rng(4)
    y = rng.integers(-100, 100, (400, 6)) + 10**9  # far from zero: what naive sums of squares lose
    parts = [summary(y[lo:hi]) for lo, hi in zip([0, 1, 2, 50, 300], [1, 2, 50, 300, 400])]
    left = {}
    for p in parts:
        left = merge(left, p)
    right = {}
    for p in parts[::-1]:
        right = merge(p, right)
    tree = merge(merge(parts[0], parts[1]), merge(parts[2], merge(parts[3], parts[4])))
    exact = np.cov((y - 10**9).T, bias=True) * 400
    for m in (left, right, tree):
        n, sums, mean, scatter = m[6]
        assert n == 400 and list(sums) == y.sum(0).tolist()
        assert np.allclose(mean, y.mean(0), rtol=1e-14) and np.allclose(scatter, exact, rtol=1e-8, atol=1e-3)


def test_deviations_beyond_doubles_and_longs():
    y = np.array([[10**17, -(10**17)], [1, 2]])
    sums = y.astype(object).sum(0)
    apart, deviation = centred(y, 2, sums)
    assert deviation[0] is None and apart.shape == (2, 2)
    y = np.array([[2**29 + 1, 3], [-(2**29), 4], [7, 7]])
    _, deviation = centred(y, 3, y.astype(object).sum(0))
    s = y.sum(0)
    assert deviation == [sum((3 * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in y]


def test_moments_stay_whole_over_many_partitions(spark):
    v = vectors(900, 5, 8)
    frame = spark.createDataFrame([(i, [float(c) for c in r], 0) for i, r in enumerate(v)], SCHEMA).repartition(67)
    d, n, sums, covariance = fit(frame.select("embedding"))
    y = np.floor(v.astype(np.float64) * whitening.SCALE)
    assert (d, n) == (5, 900) and list(sums) == y.sum(0).astype(int).tolist() and np.allclose(covariance, np.cov(y.T, bias=True), rtol=1e-12)
    values, axis, trace = axes(covariance, 3)
    assert np.all(np.diff(values) <= 0) and np.allclose(axis.T @ axis, np.eye(3)) and math.isclose(trace, np.trace(covariance))
