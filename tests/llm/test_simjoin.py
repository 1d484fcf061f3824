import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quillon.llm import _simjoin
from quillon.llm._common import salted_join
from quillon.llm._simjoin import _met, connected_components


def test_met_over_any_batches():
    rng = random.Random(1)
    for _ in range(300):
        rows = sorted((rng.randrange(8), rng.randrange(6)) for _ in range(rng.randrange(25)))
        rng.shuffle(rows)
        batches, lo = [], 0
        while lo < len(rows):
            hi = lo + rng.randint(1, 4)
            part = rows[lo:hi]
            batches.append(pa.RecordBatch.from_arrays([pa.array([i for _, i in part], pa.int64()), pa.array([k for k, _ in part], pa.int64())], names=["id", "key"]))
            lo = hi
        got = [(k, i) for b in _met(iter(batches)) for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        own = Counter(k for k, _ in set(rows))
        assert sorted(got) == sorted((k, i) for k, i in set(rows) if own[k] > 1), rows


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(1000 + k, 1001 + k) for k in range(200)] + [(5000, 6000 + k) for k in range(300)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in list(parent) if any(find(x) == find(y) for y in parent if y != x)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_met_lets_settled_rows_go():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.randrange(6), rng.randrange(9)) for _ in range(rng.randrange(60))]
        batches = [pa.RecordBatch.from_arrays([pa.array([i for _, i in rows[lo : lo + 5]], pa.int64()), pa.array([k for k, _ in rows[lo : lo + 5]], pa.int64())], names=["id", "key"]) for lo in range(0, len(rows), 5)]
        got = {(k, i) for b in _met(iter(batches), chunk=7) for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        own = Counter(k for k, _ in set(rows))
        assert got == {(k, i) for k, i in set(rows) if own[k] > 1}, rows


def test_salted_join_with_a_hot_key(spark):
    rng = random.Random(5)
    large = [(k, "hot" if k % 3 else f"k{rng.randrange(40)}", f"g{rng.randrange(2)}") for k in range(3000)] + [(4000, None, "g0"), (4001, "absent", "g0")]
    count = Counter((k, g) for _, k, g in large if k not in (None, "absent"))
    small = [(k, g, n, f"{k}-{g}") for (k, g), n in count.items()]
    a, b = spark.createDataFrame(large, "id long, k string, g string"), spark.createDataFrame(small, "k string, g string, n long, v string")
    got = salted_join(a, b, ["k", "g"], "id", "n")
    assert got.columns == ["k", "g", "id", "v"] and sorted(r.id for r in got.collect()) == list(range(3000)) and all(r.v == f"{r.k}-{r.g}" for r in got.collect())
    assert salted_join(a, b, ["k", "g"], "id", "n", how="left").count() == 3002
    assert salted_join(a, b.limit(0), ["k", "g"], "id", "n").count() == 0


def test_large_payloads_are_compared_in_parts(spark, monkeypatch):
    """The same links, whether a task's sets are decoded at once or some bytes at a time."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, (4, 300))
    sets = [np.unique(np.where(rng.random(300) < 0.03, rng.integers(0, 1 << 60, 300), base[k % 4])).astype(np.uint64) for k in range(40)]
    rows = [(7, k, 1, 0, 0, 0, 5, np.array([5], np.int64).tobytes(), s.tobytes()) for k, s in enumerate(sets)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["task", "id", "weight", "part", "i", "j", "key", "keys", "payload"])
    decode = lambda buffers: [np.frombuffer(b, np.uint64) for b in buffers]

    def links():
        out = {}
        for b in _simjoin._runner(_simjoin.jaccard_verify(0.8), decode, False, False)(iter([batch])):
            for i, n in zip(b.column("id").to_pylist(), b.column("links").to_pylist()):
                out[i] = out.get(i, 0) + n
        return out

    whole = links()
    assert len(whole) == 41 and whole[0] == 9
    for most in (20_000, 5_000, 100):
        monkeypatch.setattr(_simjoin, "BYTES", most)
        assert links() == whole
