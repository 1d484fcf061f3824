"""Chunk plans, spanning forests, nearest lists and streamed sums against plain loops."""

import math
import random
from collections import defaultdict

import pytest

from quillon.operators.graph import spanning_forest, weakest_links
from quillon.operators.joins import nearest_lists
from quillon.operators.numbering import chunk_plan
from quillon.streaming.sums import grouped_sums, matrix_stream


def greedy(sizes, most_items, most_size):
    out, start, held = [], 0, 0
    for k, z in enumerate(sizes):
        if k > start and (k - start >= most_items or held + z > most_size):
            out.append((start, k - 1, k - start, held))
            start, held = k, 0
        held += z
    return [*out, (start, len(sizes) - 1, len(sizes) - start, held)]


@pytest.mark.parametrize("block", [100_000, 7])
def test_chunks_equal_the_sequential_loop(spark, block):
    rng = random.Random(block)
    kinds = {"mixed": [rng.choice([0, 0, 1, 5, 9, 40]) for _ in range(90)], "zero": [0] * 23, "large": [50] * 11, "one": [99], "alone": [30, 30, 31, 0, 0, 60, 1]}
    rows = [(g, 3 * k - 40, z) for g, sizes in kinds.items() for k, z in enumerate(sizes)] + [("null", 5, None), ("null", 6, -7)]
    kinds["null"] = [0, 0]
    frame = spark.createDataFrame(rows, "g string, k long, z long")
    for most_items, most_size in ((5, 30), (1, 10), (1000, 60), (9, 10_000)):
        got = defaultdict(dict)
        for r in chunk_plan(frame, ["g"], "k", "z", most_items, most_size, block).collect():
            got[r.g][r.chunk] = (r.first, r.last, r.n, r.size)
        for g, sizes in kinds.items():
            first = 5 if g == "null" else -40
            want = [(first + (1 if g == "null" else 3) * a, first + (1 if g == "null" else 3) * b, n, z) for a, b, n, z in greedy(sizes, most_items, most_size)]
            assert [got[g][c] for c in sorted(got[g])] == want and sorted(got[g]) == list(range(len(want))), (g, most_items, most_size)
    assert chunk_plan(frame.where("false"), ["g"], "k", "z", 5, 30).count() == 0


def kruskal(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = set()
    for w, a, b in sorted((-w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
        x, y = find(a), find(b)
        if x != y:
            parent[y] = x
            out.add((a, b, -w))
    return out, {n: find(n) for n in list(parent)}


@pytest.mark.parametrize("seed", range(3))
def test_forest_equals_kruskal_and_weakest_links(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(6))) for _ in range(60)] + [(40 + k, 41 + k, 1.0) for k in range(25)] + [(90, 91, 2.0), (5, 5, 9.0)]
    frame = spark.createDataFrame([*edges, (None, 3, 1.0), (2, 3, None)], "a int, b int, w double")
    tree, _ = kruskal(edges)
    assert {tuple(r) for r in spanning_forest(frame).collect()} == tree
    grouped = [(g, a, b, w) for g in range(3) for a, b, w in edges[g::3]]
    want = {}
    for g in range(3):
        tree, root = kruskal(edges[g::3])
        first = root[min(root)]
        own = [n for n in root if root[n] == first]
        want[g] = (len(own), min(w for a, _, w in tree if root[a] == first))
    got = weakest_links(spark.createDataFrame(grouped, "grp int, a int, b int, w double"))
    assert {r.grp: (r.nodes, r.weakest) for r in got.collect()} == want


@pytest.mark.parametrize("block, most", [(10_000, 20), (4, 3), (2, 5)])
def test_nearest_lists_equal_all_pairs(spark, block, most):
    rng = random.Random(most)
    points = [(k, "one", rng.choice([rng.randrange(40), rng.randrange(100_000), 17])) for k in range(120)] + [(200 + k, "far", 10**9 * k) for k in range(9)] + [(300, "alone", 5), (301, None, 5), (302, "one", None)]
    got = {r.id: (r.nearest, r.list) for r in nearest_lists(spark.createDataFrame(points, "id long, chrom string, pos long"), 50, most, block).collect()}
    assert len(got) == len(points)
    for i, c, p in points:
        near = sorted((abs(p - q), j) for j, d, q in points if j != i and d == c and q is not None) if c is not None and p is not None else []
        assert got[i] == (near[0][0] if near else None, [j for g, j in near if g <= 50][:most]), i


class Stop(Exception):
    pass


@pytest.mark.parametrize("layout", ["rows", "columns"])
def test_a_stopped_stream_goes_on_and_counts_every_batch_once(spark, tmp_path, layout):
    rng = random.Random(2)
    cells = [(c, m, float(rng.randrange(1, 9)) if rng.random() < 0.95 else None) for c in range(60) for m in range(12) if rng.random() < 0.4] + [(99, 1, -2.0), (99, 2, 1.0)]
    for part in range(5):
        own = [x for x in cells if x[0 if layout == "rows" else 1] % 5 == part]
        spark.createDataFrame(own, "cell long, measure long, cnt double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    groups = {c: c % 3 for c in [*range(0, 60, 2), 99]}
    frame = spark.createDataFrame(list(groups.items()), "cell long, grp long")
    needed = spark.createDataFrame([(m,) for m in (1, 2, 7, 7)], "measure long")
    source = lambda: matrix_stream(spark, str(tmp_path / "in"), "cell long, measure long, cnt double")
    seen = []

    def fails(number):
        seen.append(number)
        if len(seen) in (2, 5, 8):
            raise Stop

    stops = 0
    while True:
        try:
            out = grouped_sums(source, layout, frame, needed, str(tmp_path / "out"), fails)
            break
        except Exception as e:  # the stream wraps what its batch raised
            assert "Stop" in str(e)
            stops += 1
    assert stops >= 2 and len(seen) > len(set(seen))  # a batch was written twice
    total = defaultdict(float)
    for c, _, x in cells:
        total[c] += x or 0
    want = defaultdict(float)
    for c, m, x in cells:
        if c in groups and m in (1, 2, 7) and x is not None and x > 0:  # a logarithm that does not exist adds nothing
            want[groups[c], m] += math.log1p(x * 1e4 / (total[c] if total[c] > 0 else 1))
    got = {(r.grp, r.measure): r.x for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    with pytest.raises(ValueError):
        grouped_sums(source, "cubes", frame, needed, str(tmp_path / "out"))
