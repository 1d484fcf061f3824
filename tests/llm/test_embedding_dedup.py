import math

import numpy as np
import pytest

from quillon.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cls int"


def brute(rows):
    usable = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = {}
    for label in {r[2] for r in usable}:
        own = [r for r in usable if r[2] == label]
        m = np.array([r[1] for r in own], np.float32).astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        near = m @ m.T >= 0.93
        for a, r in enumerate(own):
            links[r[0]] = {own[b][0] for b in np.flatnonzero(near[a]) if b != a}
    return links


def corpus(n=1500, dim=64, spread=(0.02, 0.05), seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.standard_normal(dim)
        for _ in range(rng.choice([1, 2, 5, 60], p=[0.6, 0.25, 0.13, 0.02])):
            v = base + rng.standard_normal(dim) * rng.uniform(*spread) * 4
            rows.append((len(rows) + 1, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 4)) if rng.random() < 0.3 else 1, 0))
    return rows


def test_recall_and_precision_against_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    found, there = sum(r.n_links for r in got.values()), sum(map(len, want.values()))
    assert all(got[k].n_links <= len(v) for k, v in want.items())
    assert there > 1000 and found / there >= 0.97
    for r in got.values():
        assert r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        a = rng.standard_normal(64)
        b = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 1, 0), (2 * k + 1, (0.935 * a + math.sqrt(1 - 0.935**2) * b).tolist(), 1, 0)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_links for r in got) / len(rows) >= 0.9


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1, 0), (2, v, 1, 0), (2, v, 1, 0), (3, v, 2, 0), (4, v, None, 0), (5, None, 1, 0), (6, [0.0, 0.0, 0.0], 1, 0), (7, [1.0, None, 3.0], 1, 0), (8, [1.0, float("nan"), 3.0], 1, 0), (9, [float("inf"), 1.0, 1.0], 1, 0), (10, [2.0, 4.0, 6.0], 1, 0), (11, [], 1, 0), (12, [1.0, 2.0], 1, 0), (None, v, 1, 0), (13, [-1.0, -2.0, -3.0], 1, 0)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert [by[k].n_links for k in (1, 2, 10, None)] == [4, 4, 4, 4]
    assert [by[k].component_id for k in (1, 2, 10, None)] == [1, 1, 1, 1]
    assert {k for k, r in by.items() if r.n_links == 0 and r.kept} == {3, 4, 5, 6, 7, 8, 9, 11, 12, 13}
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_huge_and_tiny_vectors(spark):
    rows = [(1, [1e200, 2e200], 1, 0), (2, [1e200, 2e200], 1, 0), (3, [2e200, 4e200], 1, 0), (4, [1e-200, 2e-200], 2, 0), (5, [2e-200, 4e-200], 2, 0), (6, [5e-324, 0.0], 3, 0), (7, [1e-323, 0.0], 3, 0), (8, [1.7e308, 1.7e308], 4, 0), (9, [1.0, 1.0], 4, 0)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()}
    assert [got[k].n_links for k in range(1, 10)] == [2, 2, 2, 1, 1, 1, 1, 1, 1]
    assert [got[k].component_id for k in range(1, 10)] == [1, 1, 1, 4, 4, 6, 6, 8, 8]


def test_components_match_brute_force(spark):
    rows = corpus(400, spread=(0.005, 0.02), seed=7)
    links = brute(rows)
    want = {r[0]: r[0] for r in rows}
    while True:
        after = {k: min([want[k], *(want[o] for o in links.get(k, ()))]) for k in want}
        if after == want:
            break
        want = after
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: r.component_id for r in got} == want and all(r.kept == (want[r.vec_id] == r.vec_id) for r in got)
    assert {r.vec_id: r.n_links for r in got} == {k: len(links.get(k, ())) for k in want}


def test_recall_with_the_most_pivots(spark):
    """At 4,096 pivots, which a table of a million vectors gets, on pairs just above the threshold."""
    rng = np.random.default_rng(21)
    a, b = rng.standard_normal((2, 2600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= a * (a * b).sum(1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    rows = []
    for k in range(2600):
        rows += [(2 * k, a[k].tolist(), 1, 0), (2 * k + 1, (0.935 * a[k] + math.sqrt(1 - 0.935**2) * b[k]).tolist(), 1, 0)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), pivots=4096).collect()
    found = sum(r.n_links for r in got) / len(rows)
    assert 0.9 <= found <= 1.01, found


def test_recall_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(14)
    base = rng.standard_normal(64)
    group = base + rng.standard_normal((1200, 64)) * 0.2
    rest = rng.standard_normal((2400, 64))
    rows = [(k, [float(x) for x in v.astype(np.float32)], 1, 0) for k, v in enumerate(np.concatenate([group, rest]))]
    want = brute(rows)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    there = sum(map(len, want.values()))
    assert there > 1_000_000 and sum(r.n_links for r in got.values()) / there >= 0.9
    assert sum(r.kept for r in got.values()) == 1 + 2400


@pytest.mark.parametrize("lean", [0.4, 0.6, 0.7, 0.8, 0.9])
def test_recall_where_vectors_lean_to_one_side(spark, lean):
    """Mean cosines as text embeddings have them; half of the pairs lie just above the threshold."""
    rng = np.random.default_rng(int(lean * 10))
    mean = np.eye(64)[0]

    def vectors(n):
        r = rng.standard_normal((n, 64))
        r[:, 0] = 0
        return math.sqrt(lean) * mean + math.sqrt(1 - lean) * r / np.linalg.norm(r, axis=1, keepdims=True)

    n = 6000 if lean < 0.9 else 700
    a = vectors(n)
    b = rng.standard_normal((n // 6, 64))
    b -= a[: len(b)] * (a[: len(b)] * b).sum(1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.935 * a[: len(b)] + math.sqrt(1 - 0.935**2) * b
    rows = [(k, v.tolist(), 1, 0) for k, v in enumerate(np.concatenate([a, near]))]
    want = sum(map(len, brute(rows).values()))
    got = sum(r.n_links for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert want >= n // 3 and 0.9 <= got / want <= 1


def test_several_lengths_lean_apart(spark):
    rng = np.random.default_rng(3)
    rows = []
    for length, shift in ((16, 0.0), (24, 3.0)):
        m = rng.standard_normal((300, length)) + shift
        m[150:] = m[:150] + rng.standard_normal((150, length)) * 0.02
        rows += [(len(rows) + k, v.tolist(), 1, 0) for k, v in enumerate(m)]
    want = sum(len(v) for n in (16, 24) for v in brute([r for r in rows if len(r[1]) == n]).values())
    got = sum(r.n_links for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert want >= 600 and 0.97 <= got / want <= 1
