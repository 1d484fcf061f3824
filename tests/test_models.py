"""Models and nulls against direct numpy versions that refit everything."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators import linear, nested, residuals
from quillon.operators.graph import chain_ends, closure
from quillon.operators.numbering import numbered, row_ranks, running_total, runs, value_ranks
from quillon.plans import views as v

SF = "/root/testdata/sf0.001"


def direct(x, y, kind, alpha):
    """Fit on standardised columns, rows and all; returns a function of raw columns."""
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z, c = (x - mean) / sd, y - y.mean()
    n, p = z.shape
    if kind == "ols":
        w = np.linalg.lstsq(z, c, rcond=None)[0]
    elif kind == "ridge":
        w = np.linalg.lstsq(np.vstack([z, math.sqrt(alpha) * np.eye(p)]), np.concatenate([c, np.zeros(p)]), rcond=None)[0]
    else:  # proximal gradient steps on the rows
        share, w = (1.0 if kind == "lasso" else 0.5), np.zeros(p)
        step = 1 / (np.linalg.eigvalsh(z.T @ z / n).max() + alpha)
        for _ in range(60_000):
            g = w - step * (z.T @ (z @ w - c) / n + alpha * (1 - share) * w)
            w = np.sign(g) * np.maximum(np.abs(g) - step * alpha * share, 0)
    return lambda new: y.mean() + ((new - mean) / sd) @ w


def screen(n=9, genes=14, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((3, genes))
    d = np.array([base[k % 3] * rng.uniform(0.5, 2) + rng.standard_normal(genes) * 0.4 for k in range(n)])
    similar = np.array([[0.0 if a == b else rng.uniform(0.1, 1) if a % 3 == b % 3 else 0.0 for b in range(n)] for a in range(n)])
    similar = np.triu(similar) + np.triu(similar).T
    return d, similar


def frames(spark, d, similar):
    rows = [(p, f"g{j:02d}", float(x)) for p, r in enumerate(d) for j, x in enumerate(r)]
    pairs = [(a, b, float(similar[a, b])) for a in range(len(d)) for b in range(len(d)) if similar[a, b] > 0]
    return spark.createDataFrame(rows, "pert int, gene string, delta double"), spark.createDataFrame(pairs, "a int, b int, w double")


def brute_loo(d, similar, alphas, k, hide):
    out = []

    def columns(i, out_of):
        free = [j for j in range(len(d)) if j not in out_of]
        mean = sum(d[j] for j in free) / len(free)
        near = sorted((j for j in free if similar[i, j] > 0), key=lambda j: (-similar[i, j], j))[:k]
        return np.column_stack([mean, sum(similar[i, j] * d[j] for j in near) / sum(similar[i, j] for j in near) if near else mean])

    for i in range(len(d)):
        train = [q for q in range(len(d)) if q not in hide[i]]
        x = {q: columns(q, hide[i] | hide[q]) for q in train}
        best = None
        for alpha in alphas:
            scores = []
            for q in train:
                others = [t for t in train if t != q]
                fit = direct(np.vstack([x[t] for t in others]), np.concatenate([d[t] for t in others]), "ridge", alpha)
                scores.append(np.corrcoef(fit(x[q]), d[q])[0, 1])
            if best is None or np.mean(scores) > best[0] + 1e-10:
                best = (np.mean(scores), alpha)
        fit = direct(np.vstack([x[t] for t in train]), np.concatenate([d[t] for t in train]), "ridge", best[1])
        own = columns(i, hide[i])
        out.append((i, best[1], *(np.corrcoef(p, d[i])[0, 1] for p in (fit(own), own[:, 0], own[:, 1]))))
    return out


@pytest.mark.parametrize("hidden", [False, True])
def test_nested_loo_matches_a_double_loop(spark, hidden):
    d, similar = screen()
    delta, pairs = frames(spark, d, similar)
    hide = [{i} | ({(i + 1) % len(d)} if hidden else set()) for i in range(len(d))]
    alphas = [0.01, 1.0, 100.0, 10_000.0]
    frame = spark.createDataFrame([(i, j) for i, h in enumerate(hide) for j in h], "pert int, other int") if hidden else None
    pairs = pairs.union(spark.createDataFrame([(50, 1, 0.9), (1, 50, 0.9), (51, 50, 0.9)], "a int, b int, w double"))  # groups without a profile
    got = sorted(map(tuple, nested.nested_loo(delta, pairs, alphas, 2, frame).collect()))
    want = brute_loo(d, similar, alphas, 2, hide)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=2e-6)
    assert len({round(g[2], 4) for g in got}) > 1


def test_penalty_never_sees_the_held_out_label(spark):
    d, similar = screen()
    alphas = [0.01, 1.0, 100.0]
    before = {r.pert: r for r in nested.nested_loo(*frames(spark, d, similar), alphas).collect()}
    other = d.copy()
    other[4] = -other[4][::-1]
    after = {r.pert: r for r in nested.nested_loo(*frames(spark, other, similar), alphas).collect()}
    assert before[4].alpha == after[4].alpha and before[4].r != after[4].r


def test_matrix_size_is_checked(spark):
    delta, _ = frames(spark, *screen())
    with pytest.raises(ValueError, match="cells"):
        linear.bounded_matrix(delta, most=50)


@pytest.mark.parametrize("kind, alpha", [("ridge", 2.0), ("lasso", 0.05), ("elasticnet", 0.05), ("ols", 0.0)])
def test_models_match_fits_on_rows(spark, kind, alpha):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 5)) * [1, 3, 0.2, 1, 1] + [0, 5, 1, 0, 0]
    x[:, 4] = 7.0  # constant
    y = x @ [1.0, -0.3, 2.0, 0.0, 1.0] + rng.standard_normal(200) * 0.3
    fold = np.arange(200) % 3
    names = [f"x{k}" for k in range(5)]
    df = spark.createDataFrame([(int(f), *map(float, a), float(b)) for f, a, b in zip(fold, x, y)], "fold int, " + ", ".join(f"{n} double" for n in names) + ", y double")
    w = {r.column: r.weight for r in linear.fit_models(df, names, "y", [(kind, alpha)]).collect()}
    fit = direct(x[:, :4], y, kind, alpha)
    assert np.allclose(w["(intercept)"] + x @ [w[n] for n in names], fit(x[:, :4]), atol=2e-4) and w["x4"] == 0
    for r in linear.fold_weights(df, "fold", names, "y", [(kind, alpha)]).collect():
        out = fold != r.fold
        assert np.allclose(r.b0 + x @ r.w, direct(x[out][:, :4], y[out], kind, alpha)(x[:, :4]), atol=1e-5)


def test_kernel_ridge_matches_refitting(spark):
    d, similar = screen(7, 10)
    delta, _ = frames(spark, d, similar)
    k = d @ d.T
    got = {(r["lambda"], r.pert): r.error for r in linear.kernel_ridge_loo(delta, [0.5, 3.0]).collect()}
    for lam in (0.5, 3.0):
        for i in range(7):
            own = [j for j in range(7) if j != i]
            pred = k[i, own] @ np.linalg.solve(k[np.ix_(own, own)] + lam * np.eye(6), d[own])
            assert got[lam, i] == pytest.approx(np.linalg.norm(d[i] - pred), abs=2e-6)
    blocks = {(r.p, r.q): r.k for r in linear.group_products(delta, 2).collect()}
    assert len(blocks) == 49 and all(blocks[a, b] == pytest.approx(k[a, b]) for a in range(7) for b in range(7))


def test_permutation_null_matches_a_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(p, f"g{j}", float(a), float(a * (p % 2) + b)) for p in range(4) for j, (a, b) in enumerate(rng.standard_normal((12, 2)))]
    got = {r.pert: r for r in linear.permutation_null(spark.createDataFrame(rows, "pert int, gene string, x double, y double"), "x", "y", 199).collect()}
    for p in range(4):
        own = sorted((g, x, y) for q, g, x, y in rows if q == p)
        seen, null = sum(x * y for _, x, y in own), []
        for b in range(199):
            order = sorted(own, key=lambda r: hashlib.sha256(f"{b}:{r[0]}".encode()).hexdigest())
            null.append(sum(o[1] * r[2] for o, r in zip(order, own)))
        assert got[p].p == pytest.approx((1 + sum(x >= seen - 1e-12 for x in null)) / 200, abs=1e-6)
        assert (got[p].null_mean, got[p].null_sd) == (pytest.approx(np.mean(null), abs=2e-6), pytest.approx(np.std(null, ddof=1), abs=2e-6))


def test_mix_ceilings(spark):
    d, similar = screen(6, 20)
    got = {r.pert: r for r in linear.mix_ceilings(frames(spark, d, similar)[0]).collect()}
    for i in range(6):
        x = np.delete(d, i, 0).T
        a = np.column_stack([np.ones(20), x])
        free = np.corrcoef(a @ np.linalg.lstsq(a, d[i], rcond=None)[0], d[i])[0, 1]
        assert got[i].free == pytest.approx(free, abs=2e-6) and got[i].single <= got[i].non_negative + 1e-6 <= got[i].free + 2e-6
        # No non-negative direction is left that lowers the error.
        xc, yc = x - x.mean(0), d[i] - d[i].mean()
        w = linear.nnls(xc.T @ xc, xc.T @ yc)
        gradient = xc.T @ (yc - xc @ w)
        assert (gradient <= 1e-6).all() and abs(gradient @ w) < 1e-6


def test_log_gamma_and_hypergeometric(spark):
    from quillon.functions import stats

    xs = [1.0, 1.5, 2.0, 10.0, 1000.5, 1e7]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.log_gamma(F.col("x"))).collect()]
    assert all(g == pytest.approx(math.lgamma(x), abs=1e-9, rel=1e-12) for g, x in zip(got, xs))


def test_chains_closures_numbers_and_runs(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 5)]
    got = {r.k: (r.root, r.depth) for r in chain_ends(spark.createDataFrame(rows, "k int, p int"), "k", "p").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (None, None), 6: (None, None), 7: (None, None)}
    rng = random.Random(4)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(40)}
    reach = {(a, b) for a, b in edges}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            break
        reach = more
    got = {tuple(r) for r in closure(spark.createDataFrame(list(edges), "a int, b int"), "a", "b").collect()}
    assert got == {(a, b) for a, b in reach if a != b}
    keys = sorted(rng.sample(range(-40, 300), 170))
    df = spark.createDataFrame([("x", k) for k in keys], "g string, k long")
    assert [r.k for r in numbered(df, "k", "n", block=7).orderBy("n").collect()] == keys
    want, first = [], keys[0]
    for a, b in zip(keys, [*keys[1:], None]):
        if b != a + 1:
            want.append((first, a, a - first + 1))
            first = b
    assert sorted((r.first, r.last, r.n) for r in runs(df, ["g"], "k", block=10).collect()) == want


def matrix(spark):
    loo = v.loo_mean(v.delta_view(spark, SF)).toPandas()
    p, c, n = loo["pred"].to_numpy(), loo["control_mean"].to_numpy(), np.log(loo["n_cells"].to_numpy())
    return np.column_stack([p, c, n, p * c, p * p, c * c]), loo["delta"].to_numpy(), loo


NAMES = ["pred", "control", "cells", "product", "square", "level"]


def test_forward_selection_and_compact_curve(spark):
    x, y, _ = matrix(spark)
    z = (x - x.mean(0)) / x.std(0)
    t = (y - y.mean()) / y.std()

    def r_of(idx, alpha):
        own = z[:, idx]
        w = np.linalg.solve(own.T @ own + alpha * np.eye(len(idx)), own.T @ t)
        return np.corrcoef(own @ w, t)[0, 1]

    path = catalog.queries()["forward_selection"](spark, SF).orderBy("step").collect()
    chosen = []
    for row in path:
        scores = {k: r_of([*chosen, k], 0.1) for k in range(6) if k not in chosen}
        k = NAMES.index(row.column)
        assert row.r == pytest.approx(scores[k], abs=2e-6) and scores[k] >= max(scores.values()) - 1e-9
        chosen.append(k)
    for row in catalog.queries()["compact_curve"](spark, SF).collect():
        idx = [NAMES.index(c) for c in row.columns.split(",")]
        assert row.r == pytest.approx(max(r_of(idx, a) for a in (0.1, 1.0, 10.0)), abs=2e-6)


def test_lasso_path_components_and_pair_kernel(spark):
    x, y, loo = matrix(spark)
    z = (x - x.mean(0)) / x.std(0)
    t = (y - y.mean()) / y.std()
    got = {(r["lambda"], r.column): r.weight for r in catalog.queries()["lasso_path"](spark, SF).collect()}
    for lam in (1.0, 0.3, 0.1, 0.03):
        w = np.array([got[lam, c] for c in NAMES])
        gradient = z.T @ (t - z @ w) / len(t)  # optimality: at lam where a weight is not 0, within it elsewhere
        assert (np.abs(gradient) <= lam + 2e-5).all() and np.allclose(gradient[w != 0], lam * np.sign(w[w != 0]), atol=2e-5)
    rows = catalog.queries()["principal_components"](spark, SF).collect()
    corr = np.corrcoef(x.T)
    for k in range(6):
        vec = np.array([next(r.loading for r in rows if r.component == k and r.column == c) for c in NAMES])
        share = next(r.share for r in rows if r.component == k)
        assert np.allclose(corr @ vec, share * 6 * vec, atol=1e-4) and vec[np.abs(vec).argmax()] > 0
    d = loo.pivot(index="pert", columns="gene", values="delta")
    m = loo.pivot(index="pert", columns="gene", values="mean")
    pairs = [(np.abs(m.loc[a] - m.loc[b]).mean(), (m.loc[a] * m.loc[b]).mean(), np.corrcoef(d.loc[a], d.loc[b])[0, 1]) for a in d.index for b in d.index if a < b]
    q = np.array(pairs)
    q = (q - q.mean(0)) / q.std(0)
    w = np.linalg.solve(q[:, :2].T @ q[:, :2] + np.eye(2), q[:, :2].T @ q[:, 2])
    got = {r.feature: r.weight for r in catalog.queries()["learned_pair_kernel"](spark, SF).collect()}
    assert np.allclose([got["gap"], got["product"]], w, atol=2e-5)


def test_derivability_and_low_rank(spark):
    _, _, loo = matrix(spark)
    p, c = loo["pred"].to_numpy(), loo["control_mean"].to_numpy()
    fold = loo["pert"].to_numpy() % 5
    basis = np.column_stack([np.ones(len(p)), p, c, p * p, p * c, c * c])
    for r in catalog.queries()["derivability"](spark, SF).collect():
        y = p * c if r.column == "product" else loo["delta"].to_numpy()
        sse = 0.0
        for f in range(5):
            b, t = basis[fold != f], y[fold != f]
            w = np.linalg.solve(b.T @ b + 1e-3 * np.diag(np.diag(b.T @ b)), b.T @ t)
            sse += ((y[fold == f] - basis[fold == f] @ w) ** 2).sum()
        assert r.r2 == pytest.approx(max(-1.0, 1 - sse / ((y - y.mean()) ** 2).sum()), abs=2e-6)
    # Held-out groups whose target is embedded differ from the mean response; those without get it.
    d = loo.pivot(index="pert", columns="gene", values="delta")
    mean = d[d.index % 5 < 3].mean(axis=0)
    rows = catalog.queries()["low_rank_baseline"](spark, SF).toPandas().pivot(index="pert", columns="gene", values="pred")
    assert sorted(rows.index) == [i for i in d.index if i % 5 >= 3]
    y = d[d.index % 5 < 3].to_numpy().T
    g = np.linalg.svd(y - y.mean(1, keepdims=True), full_matrices=False)[0][:, :4]
    assert np.allclose((rows.to_numpy() - mean.to_numpy()) @ (np.eye(len(g)) - g @ g.T), 0, atol=1e-4)


def test_weakest_link_by_removal(spark):
    got = {r.grp: r for r in catalog.queries()["weakest_link"](spark, SF).collect()}
    line = v.table(spark, SF, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_discount", "l_quantity").toPandas()
    line = line.assign(grp=line.l_suppkey % 4, a=line.l_partkey % 15, b=line.l_orderkey % 15, w=line.l_discount + line.l_quantity / 100)
    for grp, own in line[line.a < line.b].groupby("grp"):
        edges = own.groupby(["a", "b"])["w"].max().reset_index().sort_values("w", ascending=False)
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        weakest = math.inf
        for e in edges.itertuples():  # Kruskal, where the engine uses Prim
            if find(e.a) != find(e.b):
                parent[find(e.a)] = find(e.b)
                weakest = min(weakest, e.w)
        assert got[grp].weakest == pytest.approx(weakest, abs=1e-6) and got[grp].nodes == len(parent)


def test_ranks_and_totals_in_blocks(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), k, rng.choice([None, *range(40)]) if k % 3 else rng.random() * 40, rng.randrange(3)) for k in range(600)]
    rows = [(g, k, None if x is None else float(x), y) for g, k, x, y in rows]
    df = spark.createDataFrame(rows, "g string, k long, x double, y int")
    got = {(r.g, r.x): (r.n, r.mid, r.s, r.s_upto) for r in value_ranks(df, ["g"], "x", s=F.col("y").cast("long")).collect()}
    want = {}
    for g in "ab":
        own = sorted(x for h, _, x, _ in rows if h == g and x is not None)
        for x in set(own):
            at = [i + 1 for i, z in enumerate(own) if z == x]
            s = lambda f: sum(y for h, _, z, y in rows if h == g and z is not None and f(z))  # noqa: B023, E731
            want[g, x] = (len(at), sum(at) / len(at), s(lambda z: z == x), s(lambda z: z <= x))  # noqa: B023
    assert got == want
    full = df.where("x is not null")
    got = {r.k: r.n for r in row_ranks(full, ["g"], "x", "k", "n").collect()}
    want = {k: i for g in "ab" for i, (_, k) in enumerate(sorted((x, k) for h, k, x, _ in rows if h == g and x is not None), 1)}
    assert got == want
    got = {r.k: r.t for r in running_total(df, ["g"], "k", "y", F.col("y").cast("long"), "t", block=50).collect()}
    assert got == {k: sum(y for h, j, _, y in rows if h == g and j <= k) for g, k, _, _ in rows}


def test_clusters_and_their_components(spark):
    rng = np.random.default_rng(12)
    a, b = rng.standard_normal((2, 300))
    x = {"a": a, "near": a + rng.standard_normal(300) * 0.2, "copy": -a, "b": b, "fixed": np.full(300, 2.0), "chain": a + rng.standard_normal(300) * 0.25}
    df = spark.createDataFrame([tuple(float(c[k]) for c in x.values()) + (float(k),) for k in range(300)], ", ".join(f"{n} double" for n in [*x, "row"]))
    got = {r.column: (r.kind, r.cluster) for r in linear.redundancy(df.drop("row")).collect()}
    assert got == {"a": ("clustered", "a"), "near": ("clustered", "a"), "copy": ("duplicate", "a"), "b": ("single", "b"), "fixed": ("constant", "fixed"), "chain": ("clustered", "a")}
    w = {r.column: r for r in linear.merge_clusters(df, "row < 200").collect()}
    train = np.column_stack([x[c][:200] for c in ("a", "near", "copy", "chain")])
    z = (train - train.mean(0)) / train.std(0)
    vec = np.linalg.svd(z, full_matrices=False)[2][0]
    vec *= np.sign(vec[np.flatnonzero(np.abs(vec) >= np.abs(vec).max() * (1 - 1e-6))[0]])  # a and its negative weigh alike: the first decides
    assert np.allclose([w[c].weight for c in ("a", "near", "copy", "chain")], vec, atol=1e-5) and np.allclose([w[c].mean for c in ("a", "near")], train.mean(0)[:2])


def test_spectrum_and_false_positives(spark):
    d, similar = screen(8, 30)
    rows = frames(spark, d, similar)[0].withColumn("zero", F.lit(0.0))
    got = sorted(residuals.residual_spectrum(rows, "zero", "delta", 39).collect())
    assert np.allclose([r.value for r in got], np.linalg.svd(d, compute_uv=False), atol=2e-6)
    # Profiles stand behind the first components; noise is the rest.
    assert [r.p <= 0.05 for r in got[:2]] == [True] * 2 and got[5].p > 0.5
    noise = spark.createDataFrame([(p, f"g{j:02d}", float(x)) for p, r in enumerate(np.random.default_rng(2).standard_normal((6, 30))) for j, x in enumerate(r)], "pert int, gene string, delta double")
    rate = linear.null_false_positives(noise, "delta", 300, 99).head()
    assert rate.features == 300 and 0.02 <= rate.rate <= 0.09


def test_external_kernel_matches_refitting(spark):
    d, similar = screen(8, 12)
    e = np.random.default_rng(5).standard_normal((8, 9)) + np.repeat(d[:, :1], 9, 1)
    e[6] = 0
    ext = spark.createDataFrame([(p, f"e{j}", float(x)) for p, r in enumerate(e) if p != 7 for j, x in enumerate(r)], "pert int, gene string, delta double")
    got = linear.external_kernel(ext, frames(spark, d, similar)[0], [0.1, 1.0, 10.0]).toPandas()
    z = e[:6] / np.linalg.norm(e[:6], axis=1, keepdims=True)
    for i in range(8):
        own = got[got.pert == i].sort_values("gene")
        free = [j for j in range(6) if j != i]
        if i >= 6:
            assert own["lambda"].isna().all() and np.allclose(own.value, np.delete(d, i, 0).mean(0), atol=1e-6)
            continue
        y, k = d[free] - d[free].mean(0), z[free] @ z[free].T

        def error(lam):
            out = 0.0
            for a in range(5):  # the intercept is the mean of all five, as in the closed form
                rest = [b for b in range(5) if b != a]
                out += ((y[a] - k[a, rest] @ np.linalg.solve(k[np.ix_(rest, rest)] + lam * np.eye(4), y[rest])) ** 2).sum()  # noqa: B023
            return out

        lam = min([0.1, 1.0, 10.0], key=error)
        want = d[free].mean(0) + z[i] @ z[free].T @ np.linalg.solve(k + lam * np.eye(5), y)
        assert (own["lambda"] == lam).all() and np.allclose(own.value, want, atol=2e-6)


def test_group_correlations_over_shared_measures(spark):
    rng = np.random.default_rng(17)
    rows = [(p, f"g{j}", float(x)) for p in range(9) for j, x in enumerate(rng.standard_normal(15) + 100) if rng.random() < 0.8]
    rows += [(9, f"g{j}", 5.0) for j in range(15)] + [(10, "g0", 1.0), (10, "g1", None), (10, "other", 2.0)]
    got = {(r.p, r.q): (r.n, r.r) for r in linear.group_correlations(spark.createDataFrame(rows, "pert int, gene string, delta double"), block=4).collect()}
    own = {p: {g: x for q, g, x in rows if q == p and x is not None} for p in range(11)}
    for a in range(11):
        for b in range(11):
            if a != b:
                both = sorted(own[a].keys() & own[b].keys())
                x, y = np.array([own[a][g] for g in both]), np.array([own[b][g] for g in both])
                r = np.corrcoef(x, y)[0, 1] if len(both) > 1 and x.std() > 0 and y.std() > 0 else 0.0
                assert got[a, b][0] == len(both) and got[a, b][1] == pytest.approx(r, abs=1e-6), (a, b)
