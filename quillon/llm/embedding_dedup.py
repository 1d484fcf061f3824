"""Embedding near-duplicates by a pivot-permutation index (operator 10).

Reference points (pivots) are vectors of the table itself, the first by a hash: a documented sample of
4 sqrt(n), between LEAST_PIVOTS and MOST_PIVOTS, without those near an earlier one. Every vector is described by its nearest pivots in
order. It enters an inverted list for each pair of its first HEAD pivots (and its label); vectors that meet in a
list and share at least SHARED of their first HEAD + MORE pivots are candidates, verified by the cosine in double
precision. Where vectors lean to one side, as text embeddings do, the mean of their unit vectors is subtracted before pivots are ranked
(the cosine that is verified stays that of the vectors): else few pivots near the mean would be everybody's. The rest of a pair at the threshold t with mean cosine c
has the cosine (t - c) / (1 - c); the lower it is and the more pivots there are, the more pivots a vector enters with. Where it is below LEAN,
nearly all vectors are near each other, and the raw vectors are ranked. The index is approximate only in what it retrieves (recall is measured in the tests); no list is capped.

Defined cases: equal vectors of a label are one class, whose members link with each other. Vectors that are null, empty,
zero, or hold null or non-finite components, and rows with a null label, link with nothing, and so do vectors
of different lengths. Rows with a null id count as vectors; their own component is null unless they link, and they are not kept.
Repeated rows count as vectors of their own. Components may have any finite size, from the smallest double to the largest. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BASE, mix64, salted_join, stage, table
from ._simjoin import bucket_join, connected_components, meeting

THRESHOLD, MORE, SHARED = 0.93, 4, 3
#: Pivots that a vector enters lists with: at the threshold of an isotropic table, at most, and for each unit that the rest's cosine is lower; the least cosine of the rest.
HEAD, MOST_HEAD, STEEP, LEAN = 6, 16, 28, 0.5
LEAST_PIVOTS, MOST_PIVOTS, APART, SEED = 128, 4096, 0.8, 5


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are first scaled by their largest component, as squares of huge or tiny ones do not fit a double."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, place, n, x): the sums of a partition's unit vectors."""
    own: dict[int, np.ndarray] = {}
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            vectors = b.column("embedding").slice(lo, 1024).to_pylist()
            for length in {len(v) for v in vectors}:
                m = _unit(np.array([v for v in vectors if len(v) == length], np.float64))
                own[length] = own.get(length, 0) + np.append(m.sum(0), len(m))
    for length, x in own.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(length, length)), pa.array(np.arange(length)), pa.array(np.full(length, int(x[-1]))), pa.array(x[:-1])], ["length", "place", "n", "x"])


def _lean(classes: DataFrame, lengths: list[int], threshold: float, count: int) -> dict[int, tuple[np.ndarray, int]]:
    """For each vector length what is subtracted from unit vectors, and how many pivots a vector enters lists with."""
    summed = classes.where(F.size("embedding").isin(lengths)).select("embedding").mapInArrow(_sums, "length long, place long, n long, x double")
    rows = summed.groupBy("length", "place").agg((F.sum("x") / F.sum("n")).alias("x")).collect()  # a row a dimension
    means = {length: np.zeros(length) for length in lengths}
    for r in rows:
        means[r.length][r.place] = r.x
    out = {}
    for length, mean in means.items():
        c = float(mean @ mean)
        rest = (threshold - c) / (1 - c) if c < 1 else 0.0
        if rest < LEAN:
            mean, rest = np.zeros(length), threshold
        out[length] = (mean, min(MOST_HEAD, int(np.ceil(HEAD + STEEP * max(0.0, threshold - rest - 0.01) + max(0.0, np.log2(max(count, 1) / 2048))))))
    return out


def _from(unit: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit vectors' directions from the mean."""
    if not mean.any():
        return unit
    rest = unit - mean
    return rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-300)


def _pivots(sample: list[list[float]], mean: np.ndarray, count: int) -> np.ndarray:
    """Unit pivots of one vector length, from the mean: the sample's, without those that lie APART or nearer to an earlier one, and seeded random ones up to LEAST_PIVOTS.

    So a large group of near copies has one pivot and not a share of them, whose order among each other would say nothing.
    """
    length = len(mean)
    own = [v for v in sample if len(v) == length]
    kept = np.zeros((0, length))
    if own:
        m = _from(_unit(np.array(own, np.float64)), mean)
        near, stay = m @ m.T, np.ones(len(m), bool)
        for k in range(len(m)):
            if stay[k]:
                stay[k + 1 :] &= near[k, k + 1 :] < APART
        kept = m[stay]
    more = max(0, min(count, LEAST_PIVOTS) - len(kept))
    return np.concatenate([kept, _unit(np.random.default_rng(SEED).standard_normal((more, length)))]) if more else kept


def _describer(sample: list[list[float]], count: int, lean: dict[int, tuple[np.ndarray, int]]):
    schema = pa.schema([("id", pa.int64()), ("key_list", pa.list_(pa.int64())), ("keys", pa.binary()), ("payload", pa.binary())])
    pivots: dict[int, np.ndarray] = {}
    # Keys and places are as many for every vector; a length that enters with fewer pivots repeats its last pair and has empty places.
    most = max((head for _, head in lean.values()), default=HEAD)

    def describe(unit: np.ndarray, label: np.ndarray):
        n, length = unit.shape
        mean, head = lean.get(length) or (np.zeros(length), HEAD)
        if length not in pivots:
            pivots[length] = _pivots(sample, mean, count)
        p = pivots[length]
        near = _from(unit, mean) @ p.T
        prefix, all_places = head + MORE, most + MORE
        m = min(prefix, len(p))
        top = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < len(p) else np.tile(np.arange(m), (n, 1))
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
        if m < all_places:
            top = np.concatenate([top, np.full((n, all_places - m), -1)], axis=1)
        a, b = np.triu_indices(min(head, max(m, 2)), 1)
        low, high = np.minimum(top[:, a], top[:, b]), np.maximum(top[:, a], top[:, b])
        code = (low + 1).astype(np.uint64) * np.uint64(1 << 20) + (high + 1).astype(np.uint64)
        keys = mix64(code * np.uint64(BASE) + mix64(label.astype(np.int64).view(np.uint64) + np.uint64(length << 32))[:, None]).view(np.int64)
        width = most * (most - 1) // 2
        return top.astype(np.int32), np.concatenate([keys, np.repeat(keys[:, -1:], width - keys.shape[1], axis=1)], axis=1)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                c = b.slice(lo, 1024)
                ids, labels = c.column("id").to_numpy(zero_copy_only=False), c.column("label").to_numpy(zero_copy_only=False)
                vectors = c.column("embedding").to_pylist()
                for length in sorted({len(v) for v in vectors}):
                    at = np.array([k for k, v in enumerate(vectors) if len(v) == length])
                    m = _unit(np.array([vectors[k] for k in at], np.float64))
                    top, keys = describe(m, labels[at])
                    payload = [t.tobytes() + v.tobytes() for t, v in zip(top, m)]
                    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(keys).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), lists, pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(payload, pa.binary())], schema=schema)

    return run


def _decoder(places: int):
    def decode(buffers) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.frombuffer(b, np.int32, places), np.frombuffer(b, np.float64, offset=4 * places)) for b in buffers]

    return decode


def _verifier(threshold: float, shared: int):
    def verify(members, i, j):
        tops = np.stack([m[0] for m in members])
        unit = np.zeros((len(members), max(len(m[1]) for m in members)))
        for k, m in enumerate(members):  # of several lengths, whose pairs never meet
            unit[k, : len(m[1])] = m[1]
        out = np.full(len(i), -1.0)
        step = max(1, (1 << 20) // max(unit.shape[1], tops.shape[1] ** 2 // 8))
        for x in range(0, len(i), step):
            a, b = tops[i[x : x + step]], tops[j[x : x + step]]
            common = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(2).sum(1)
            cosine = np.einsum("nd,nd->n", unit[i[x : x + step]], unit[j[x : x + step]])
            out[x : x + step] = np.where((common >= np.minimum(shared, (a >= 0).sum(1))) & (cosine >= threshold), np.minimum(cosine, 1.0), -1.0)
        return out

    return verify


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, shared: int = SHARED, pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings (vec_id, embedding, label). pivots: their number, if not by the table's size."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "embedding", "label", F.when(valid, F.xxhash64("label", "embedding")).alias("cls"))
    classes = stage(rows.where("cls is not null").groupBy("cls", "label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")), "op10-classes")
    n = classes.count()
    count = pivots or int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 4 * n**0.5)))
    sample = [r.embedding for r in classes.orderBy(F.xxhash64("cls", F.lit(SEED)), "cls").select("embedding").limit(count).collect()]  # MOST_PIVOTS rows at most
    lean = _lean(classes, sorted({len(v) for v in sample}), threshold, count)
    places = max((head for _, head in lean.values()), default=HEAD) + MORE
    described = stage(classes.select(F.col("cls").alias("id"), "label", "embedding").mapInArrow(_describer(sample, count, lean), "id long, key_list array<long>, keys binary, payload binary"), "op10-index")

    def items(ids: DataFrame) -> DataFrame:
        return described.drop("key_list").join(ids, "id", "left_semi").join(classes.select(F.col("cls").alias("id"), "weight"), "id")

    links = bucket_join(items, _verifier(threshold, shared), _decoder(places), meeting(described.select("id", F.explode(F.array_distinct("key_list")).alias("key")), "op10", once=True), "op10", unordered=True).where("id is not null")
    by_class = links.groupBy(F.col("id").alias("cls")).agg(F.sum("links").alias("links"))
    groups = connected_components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "op10").withColumnRenamed("id", "cls")
    per = classes.select("cls", "least", "weight").join(by_class, "cls", "left").join(groups, "cls", "left")
    per = per.select("cls", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"), "weight")
    per = stage(per, "op10-per", compact=True)
    per = stage(salted_join(per, per.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), ["component"], "cls", "n", total=n).select("cls", "n_links", "component_id", "weight"), "op10-classed", compact=True)
    own = F.col("vec_id")
    linked = salted_join(rows.where("cls is not null").select("vec_id", "cls"), per, ["cls"], "vec_id", "weight").select("vec_id", "n_links", F.coalesce("component_id", own).alias("component_id"))
    out = linked.unionAll(rows.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(own == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
