"""Operators whose work must grow with their input, compared with brute force, and limits that the order of a sum must not decide."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators.graph import chain_hits, closure, components
from quillon.operators.neighbours import cosine_neighbours
from quillon.plans import views

SF = "/root/testdata/sf0.001"


def test_verdict_at_a_limit(spark, tmp_path):
    # The mean is 45; summed in this order it is 44.99999999999999, backwards 45.
    x = [29.41, 25.86, 26.54, 26.28, 1.86, 97.06, 63.65, 2.95, 65.58, 137.76, 9.26, 53.79]
    rows = [(user * 100 + k, dt.datetime(2024, 1, 1), user, "a", value, "") for user, values in ((1, x), (2, x[::-1]), (3, [44.99] * 12)) for k, value in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert dict(catalog.queries()["feature_verdict"](spark, str(tmp_path)).collect()) == {1: "too few;noise", 2: "too few;noise", 3: "gain;too few"}


def test_chain_hits(spark):
    rng = random.Random(5)
    # Chains, ends that are no key, and cycles, with and without a hit.
    rows = [(k, rng.choice([None, rng.randrange(400), k // 2]), rng.choice([None, False, False, False, False, k % 7 == 0])) for k in range(300)] + [(k, k + 1 if k < 1049 else 1000, False) for k in range(1000, 1050)]
    up, mark = {k: p for k, p, _ in rows}, {k: bool(h) for k, _, h in rows}

    def hit(k):
        met = set()
        while k in up and k not in met:
            if mark[k]:
                return True
            met.add(k)
            k = up[k]
        return False

    got = dict(chain_hits(spark.createDataFrame(rows, "k int, p int, h boolean"), "k", "p", "h").collect())
    assert got == {k: hit(k) for k in up}


def test_warm_start_refused(spark, tmp_path):
    spark.range(2, 3000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    bad = set()
    for k in range(2, 3000):
        if k % 29 == 0 or k // 2 in bad:
            bad.add(k)
    got = [r.f for r in catalog.queries()["warm_start"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(set(range(2, 3000)) - bad)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_of_leaves(spark, seed):
    rng = random.Random(seed)
    # A broad graph with shared sets of parents, two cycles, loops and missing ends.
    edges = [(k, k // 5) for k in range(1, 400)] + [(k, k // 9) for k in range(300, 400)] + [(900, 901), (901, 900), (902, 900), (903, 900), (7, 7), (5, None)]
    edges += [(rng.randrange(500, 600), rng.randrange(100)) for _ in range(150)]
    up = {}
    for a, b in edges:
        if b is not None and a != b:
            up.setdefault(a, set()).add(b)
    want = set()
    for k in up:
        met, todo = set(), list(up[k])
        while todo:
            b = todo.pop()
            if b not in met:
                met.add(b)
                todo += up.get(b, ())
        want |= {(k, b) for b in met if b != k}
    rows = closure(spark.createDataFrame(edges, "a int, b int"), "a", "b", peel=1).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_blocks_of_neighbours_agree(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 6))
    x[100:140] = x[50]  # a group of copies: ties by id in every block
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 12)
    want = {(a, b) for a in range(700) for b in sorted((b for b in range(700) if b != a), key=lambda b: (-near[a, b], b))[:5]}
    df = spark.createDataFrame([(k, a.tolist()) for k, a in enumerate(x)], "id int, x array<double>")
    for block in (97, 701):
        assert {(r.a, r.b) for r in cosine_neighbours(df, 5, block=block).collect()} == want
    # A cosine has the same value from both sides.
    s = {(r.a, r.b): r.s for r in cosine_neighbours(df, 5, block=97).collect()}
    assert all(s[b, a] == value for (a, b), value in s.items() if (b, a) in s)


def test_components_read_their_edges_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            reads.add(1)
            yield r

    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8)], "a int, b int").rdd.mapPartitions(seen).toDF("a int, b int")
    assert dict(components(edges, "a", "b").collect()) == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    assert reads.value == 3


def test_screen_is_read_once_in_parts_of_bounded_rows(spark, monkeypatch):
    views.delta_view(spark, SF)  # the first session's set-up
    plans = []
    seen = views.cut
    monkeypatch.setattr(views, "cut", lambda df: plans.append(df) or seen(df))
    want = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in views.delta_view(spark, SF).collect())
    monkeypatch.setattr(views, "ROWS", 500)
    delta = views.delta_view(spark, SF)
    assert sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in delta.collect()) == want
    assert "Scan parquet" not in delta._jdf.queryExecution().toString() and len(plans) == 2
    n = views.table(spark, SF, "lineitem").count()
    assert "hashpartitioning(cell#" in (plan := plans[-1]._jdf.queryExecution().toString()) and f", {n // 500 + 1}), REPARTITION_BY_NUM" in plan


def test_profiles_count_cells_of_several_groups(spark):
    rows = [(1, 0, "a", 2.0), (1, 0, "b", 1.0), (1, 5, "a", 3.0), (2, 5, "a", 5.0), (3, 0, "b", 7.0), (3, 0, "b", 1.0), (None, 0, "a", 1.0)]
    got = {(r.pert, r.gene): (r.n_cells, r.mean) for r in views.profiles(spark.createDataFrame(rows, "cell int, pert int, gene string, x double")).collect()}
    assert got == {(0, "a"): (2, 1.5), (0, "b"): (2, 4.5), (5, "a"): (2, 4.0), (5, "b"): (2, 0.0)}
