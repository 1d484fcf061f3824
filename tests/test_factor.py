"""Distributed singular value decompositions and residual structure against numpy on the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import factor, residuals


def long(spark, m):
    rows = [(f"r{i:04d}", j, float(x)) for i, r in enumerate(m) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "row string, col int, x double")


def made(n, m, rank, noise, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, rank)) @ np.diag(2.0 ** np.arange(rank)) @ rng.standard_normal((rank, m)) + noise * rng.standard_normal((n, m))


@pytest.mark.parametrize("exact", [256, 8])
@pytest.mark.parametrize("n, m", [(60, 40), (20, 50)])
def test_singular_values_equal_numpy(spark, monkeypatch, exact, n, m):
    monkeypatch.setattr(factor, "EXACT", exact)
    monkeypatch.setattr(factor, "CELLS", 200)  # several blocks a task
    a = made(n, m, 4, 0.5, n)
    frame, names = factor.matrix_rows(long(spark, a).repartition(5), "row", "col", "x")
    assert names == list(range(m))
    values, right, squares = factor.singular(frame, m, 6)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values[0], s[:6], rtol=1e-8) and np.isclose(squares, (a * a).sum())
    for k in range(6):
        assert np.allclose(right[:, k] * np.sign(right[:, k] @ vt[k]), vt[k], atol=1e-5)
        assert factor.sign_of(right[:, k]) == 1.0
    got = {(r.row, r.component): r.score for r in factor.left_scores(frame, right, "string").collect()}
    assert len(got) == n * 6 and all(abs(got[f"r{i:04d}", k] - a[i] @ right[:, k]) < 1e-9 for i in range(n) for k in range(6))


def test_a_flat_spectrum_is_found_through_the_krylov_range(spark, monkeypatch):
    monkeypatch.setattr(factor, "EXACT", 8)
    a = np.random.default_rng(3).standard_normal((80, 60))
    frame, _ = factor.matrix_rows(long(spark, a), "row", "col", "x")
    assert np.allclose(factor.singular(frame, 60, 5)[0][0], np.linalg.svd(a, compute_uv=False)[:5], rtol=1e-6)


def test_small_values_beside_large_ones_survive(spark):
    """A Gram matrix would lose values below 1e-8 of the largest."""
    rng = np.random.default_rng(1)
    u, v = (np.linalg.qr(rng.standard_normal((30, 5)))[0] for _ in range(2))
    a = u @ np.diag([1e6, 1, 1e-3, 1e-4, 1e-5]) @ v.T
    frame, _ = factor.matrix_rows(long(spark, a).repartition(4), "row", "col", "x")
    assert np.allclose(factor.singular(frame, 30, 5)[0][0], [1e6, 1, 1e-3, 1e-4, 1e-5], rtol=1e-4)


def test_replicates_permute_each_row_and_nothing_else(spark, monkeypatch):
    a = made(25, 12, 2, 0.3, 9)
    frame, _ = factor.matrix_rows(long(spark, a), "row", "col", "x")
    exact = factor.singular(frame, 12, 3, 11)[0]
    for rep in range(11):
        p = np.array([r[factor._order(rep, f"r{i:04d}", 12)] for i, r in enumerate(a)])
        assert np.allclose(exact[1 + rep], np.linalg.svd(p, compute_uv=False)[:3], rtol=1e-9)
    monkeypatch.setattr(factor, "EXACT", 4)
    assert np.allclose(factor.singular(frame.repartition(6), 12, 3, 11)[0], exact, rtol=1e-6)


def test_missing_repeated_and_odd_cells(spark):
    rows = [("a", 0, 1.0), ("a", 0, 2.0), ("b", 1, 5.0), ("b", 2, None), ("c", 2, float("nan"))]
    frame, names = factor.matrix_rows(spark.createDataFrame(rows, "row string, col int, x double"), "row", "col", "x")
    assert names == [0, 1, 2] and np.allclose(factor.singular(frame, 3, 2)[0][0], [5, 3])
    empty, names = factor.matrix_rows(spark.createDataFrame([], "row string, col int, x double"), "row", "col", "x")
    assert names == [] and empty.count() == 0


def residual_rows(spark, d):
    rows = [(p, f"g{j:02d}", float(x)) for p, r in enumerate(d) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "pert int, gene string, delta double").withColumn("zero", F.lit(0.0))


def test_structure_tells_a_shared_program_from_one_bad_group(spark):
    rng = np.random.default_rng(6)
    noise = rng.standard_normal((14, 50)) * 0.2
    program = np.outer(rng.uniform(0.8, 1.2, 14) * np.tile([1, -1], 7), rng.standard_normal(50)) + noise
    one = noise.copy()
    one[4] += rng.standard_normal(50) * 3
    for d, shared in ((program, True), (one, False)):
        got = residuals.residual_structure(residual_rows(spark, d), "zero", "delta").orderBy("component").collect()
        u, s, vt = np.linalg.svd(d, full_matrices=False)
        share = s**2 / (s**2).sum()
        assert np.allclose([r.share for r in got], share[:5], atol=2e-6) and np.allclose([r.cumulative for r in got], np.cumsum(share)[:5], atol=2e-6)
        assert np.allclose([r.top_group_share for r in got], (u[:, :5] ** 2).max(0), atol=1e-5)
        assert got[0].low_rank and all(r.null_min <= r.null_share <= r.null_max for r in got) and (got[0].top_group_share < 0.3) == shared
        listed = residuals.residual_loadings(residual_rows(spark, d), "zero", "delta", 2, 4).collect()
        for c in (1, 2):
            flip = factor.sign_of(u[:, c - 1])
            groups = [(r.name, r.loading) for r in sorted(listed, key=lambda r: r.place) if r.component == c and r.side == "group"]
            measures = [(r.name, r.loading) for r in sorted(listed, key=lambda r: r.place) if r.component == c and r.side == "measure"]
            want = [(str(k), flip * u[k, c - 1] * s[c - 1]) for k in np.argsort(-np.abs(u[:, c - 1]))[:4]]
            also = [(f"g{k:02d}", flip * vt[c - 1, k]) for k in np.argsort(-np.abs(vt[c - 1]))[:4]]
            for got_side, want_side in ((groups, want), (measures, also)):
                assert [n for n, _ in got_side] == [n for n, _ in want_side] and np.allclose([x for _, x in got_side], [x for _, x in want_side], atol=1e-5)


def test_residuals_of_nothing(spark):
    zero = residual_rows(spark, np.zeros((3, 4)))
    assert [r.share for r in residuals.residual_structure(zero, "zero", "delta").collect()] == [0.0] * 3
    assert residuals.residual_loadings(zero, "zero", "delta").count() == 0
    none = zero.where("false")
    assert residuals.residual_spectrum(none, "zero", "delta").count() == residuals.residual_structure(none, "zero", "delta").count() == 0
