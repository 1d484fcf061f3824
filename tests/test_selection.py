"""Subset scores, lasso, stacks and rank against fits on the rows."""

import hashlib
import itertools

import numpy as np
import pytest

from quillon.operators import selection
from quillon.operators.selection import Subsets, column_rank, half_samples, lasso_cv, lasso_stability, stacks, sweep

NAMES = ["a", "b", "c", "d"]


def made(spark, groups=9, rows=12, seed=1, copy=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((groups * rows, 4)) * [1, 5, 0.1, 1] + [0, 3, 0, 10]
    if copy:
        x[:, 3] = 2 * x[:, 0] - 1
    y = x[:, 0] - 0.3 * x[:, 1] + 4 * x[:, 2] + rng.standard_normal(len(x)) * 1.5
    g = np.repeat(np.arange(groups), rows)
    data = [(int(k), int(k % 3), *map(float, r), float(v)) for k, r, v in zip(g, x, y)]
    return spark.createDataFrame([*data, (0, 0, 1.0, None, 1.0, 1.0, 1.0), (1, 1, float("nan"), 1.0, 1.0, 1.0, 1.0)], "g int, f int, a double, b double, c double, d double, y double"), x, y, g


def ridge(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / np.where(sd > 0, sd, 1)
    w = np.linalg.lstsq(np.vstack([z, np.sqrt(alpha) * np.eye(x.shape[1])]), np.concatenate([y - y.mean(), np.zeros(x.shape[1])]), rcond=None)[0]
    return lambda new: y.mean() + ((new - mean) / np.where(sd > 0, sd, 1)) @ w


def refit(x, y, g, columns, alpha):
    out = {}
    for f in range(3):
        test = g % 3 == f
        pred = ridge(x[~test][:, columns], y[~test], alpha)(x[test][:, columns])
        for k in np.unique(g[test]):
            out[k] = np.corrcoef(pred[g[test] == k], y[test][g[test] == k])[0, 1]
    r = np.array([out[k] for k in sorted(out)])
    return r.mean(), r.std(ddof=1) / np.sqrt(len(r))


@pytest.mark.parametrize("copy", [False, True])
def test_every_subset_scores_as_its_refit(spark, copy):
    data, x, y, g = made(spark, copy=copy)
    engine = Subsets(data, "g", "f", NAMES, "y", 2.0)
    subsets = [s for n in range(1, 5) for s in itertools.combinations(range(4), n)]
    want = {sum(1 << k for k in s): refit(x, y, g, list(s), 2.0) for s in subsets}
    got = engine.scores(want)
    assert got.keys() == want.keys() and all(np.allclose(got[m], want[m], atol=1e-9) for m in want)
    for name, single, full, less in engine.single_and_drop_one():
        k = NAMES.index(name)
        assert np.allclose([single, full, less], [want[1 << k][0], want[15][0], want[15][0] - want[15 ^ 1 << k][0]], atol=1e-9)
    now, path = (), []
    while len(now) < 4:
        best = max(want[sum(1 << k for k in (*now, j))][0] for j in range(4) if j not in now)
        j = min(j for j in range(4) if j not in now and want[sum(1 << k for k in (*now, j))][0] >= best - 1e-10)
        now = (*now, j)
        path.append((len(now), NAMES[j]))
    assert [p[:2] for p in engine.path()] == path
    back = engine.path(forward=False)
    assert [p[0] for p in back] == [3, 2, 1] and len({p[1] for p in back}) == 3


def test_memo_asks_spark_once(spark, monkeypatch):
    data, *_ = made(spark)
    engine = Subsets(data, "g", "f", NAMES, "y", 1.0)
    engine.path()
    jobs = []
    monkeypatch.setattr(engine, "_weights", lambda *a: jobs.append(a))
    engine.path()
    assert not jobs


def test_sweeping_twice_gives_the_matrix_back():
    a = np.cov(np.random.default_rng(2).standard_normal((5, 40)))
    assert np.allclose(sweep(sweep(a, 2), 2), a)
    both = sweep(sweep(a, 0), 3)
    assert np.allclose(both[[0, 3], -1], np.linalg.solve(a[np.ix_([0, 3], [0, 3])], a[[0, 3], -1]))


def descent(x, y, lam):
    """Lasso by proximal gradient steps on rows: half the mean squared error plus lam times the absolute weights."""
    w, step = np.zeros(x.shape[1]), 1 / np.linalg.eigvalsh(x.T @ x / len(x)).max()
    for _ in range(20_000):
        w = w - step * (x.T @ (x @ w - y) / len(x))
        w = np.sign(w) * np.maximum(np.abs(w) - step * lam, 0)
    return w


def test_penalty_and_frequencies_equal_loops_on_rows(spark):
    data, x, y, g = made(spark, 10, 15, 4)
    grid, k, _ = lasso_cv(data, "f", NAMES, "y", 12)
    top = np.abs((x - x.mean(0)).T @ (y - y.mean()) / x.std(0)).max() / len(y)
    assert np.allclose([p for p, _ in grid], top * np.logspace(0, -3, 12))
    errors = []
    for lam, _ in grid:
        error = 0
        for f in range(3):
            test = g % 3 == f
            mean, sd = x[~test].mean(0), x[~test].std(0)
            w = descent((x[~test] - mean) / sd, y[~test] - y[~test].mean(), lam)
            error += (((y[test] - y[~test].mean() - (x[test] - mean) / sd @ w) ** 2).mean()) / 3
        errors.append(error)
    assert np.allclose([e for _, e in grid], errors, rtol=1e-6) and k == int(np.argmin(errors))
    halves = {}
    for r in half_samples(spark.createDataFrame([(j,) for j in range(10)], "group int"), 8).collect():
        halves.setdefault(r.replicate, set()).add(r.group)
    for rep, own in halves.items():
        assert own == set(sorted(range(10), key=lambda j: hashlib.sha256(f"{rep}:{j}".encode()).hexdigest())[:5])  # noqa: B023
    z = (x - x.mean(0)) / x.std(0)
    weights = []
    for own in halves.values():
        use = np.isin(g, list(own))
        weights.append(descent(z[use] - z[use].mean(0), y[use] - y[use].mean(), grid[k][0]))
    got = {r.column: r for r in lasso_stability(data, "g", "f", NAMES, "y", 8, 12).collect()}
    for c, name in enumerate(NAMES):
        own = np.abs([w[c] for w in weights])
        assert got[name].frequency == (own > 1e-9).mean() and np.isclose(got[name].magnitude, own.mean(), atol=2e-6)


def test_stacks_choose_among_the_others(spark):
    data, x, y, g = made(spark, 6, 8, 3)
    alphas = [0.01, 1.0, 30.0, 1000.0]
    got = {r.group: r for r in stacks(data, "g", ["a", "b", "c"], "y", alphas).collect()}
    for i in range(6):
        best = None
        for alpha in alphas:
            r = []
            for q in range(6):
                if q != i:
                    use, own = ~np.isin(g, [i, q]), g == q
                    r.append(np.corrcoef(ridge(x[use, :3], y[use], alpha)(x[own, :3]), y[own])[0, 1])
            if best is None or np.mean(r) > best[0] + 1e-11:
                best = (np.mean(r), alpha)
        r = np.corrcoef(ridge(x[g != i, :3], y[g != i], best[1])(x[g == i, :3]), y[g == i])[0, 1]
        assert got[i].alpha == best[1] and abs(got[i].r - r) < 2e-6
    few = stacks(data.where("g < 2"), "g", ["a"], "y", alphas).collect()
    assert all(r.alpha is None and r.r is None for r in few)


def test_rank_of_dependent_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 4)) * [1, 2, 3, 1] + 4
    whole = np.column_stack([x, x[:, 0] + x[:, 1], 3 - x[:, 2], np.full(80, 7.0)])
    names = list("abcdefg")
    frame = spark.createDataFrame([tuple(map(float, r)) for r in whole], ", ".join(f"{n} double" for n in names))
    got = column_rank(frame, names).head()
    z = whole[:, :6] - whole[:, :6].mean(0)
    z /= z.std(0)
    values = np.linalg.eigvalsh(z.T @ z / 80)
    assert got["rank"] == np.linalg.matrix_rank(z) == 4 and (got.n_columns, got.n_constant, got.condition) == (7, 1, None)
    assert np.isclose(got.effective_rank, values.sum() ** 2 / (values**2).sum(), atol=1e-6)
    assert np.linalg.matrix_rank(z[:, [names.index(c) for c in got.independent]]) == 4
    free = column_rank(frame, list("abcd")).head()
    values = np.linalg.eigvalsh(np.corrcoef(x.T))
    assert free["rank"] == 4 and np.isclose(free.condition, values.max() / values.min(), rtol=1e-4)
    assert column_rank(frame.where("false"), names).head()["rank"] == 0


def test_tables_without_rows(spark):
    data, *_ = made(spark)
    none = data.where("false")
    assert Subsets(none, "g", "f", NAMES, "y", 1.0).single_and_drop_one() == [] and Subsets(none, "g", "f", NAMES, "y", 1.0).path() == []
    assert lasso_cv(none, "f", NAMES, "y")[0] == [] and lasso_stability(none, "g", "f", NAMES, "y").count() == 0
    assert stacks(none, "g", NAMES, "y", [1.0]).count() == 0
    assert selection.square([1, 2, 3], 2).tolist() == [[1, 2], [2, 3]]
