"""Verified similarity join over hash buckets, and distributed union-find.

The join never emits the pairs of a bucket.  A bucket of more than BLOCK members
is dealt out over square blocks of member pairs; each block verifies its pairs
in one task and returns one row per linked member: its links in that block and
the smallest member of its group there.  Rows are therefore linear in members,
no bucket is capped, and each pair is verified in the first bucket that holds it.
The pairs of one bucket are the square of its members, as exact link counts need; rows and memory are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import salted_join, stage, unstage

#: Members of a block; a task holds the payloads of two blocks at most (about 1.5 times that by chance).
BLOCK = 256
#: Rows of keys that a task holds before it lets go of those it has settled.
CHUNK = 1_000_000
#: Bytes of payloads that are decoded and compared at once; a task with more compares parts of its members with each other.
BYTES = 32 << 20

_LARGEST = np.iinfo(np.int64).max

Verify = Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def jaccard_verify(threshold: float) -> Verify:
    """Exact Jaccard similarity of pairs of sorted distinct uint64 arrays; -1 below the threshold."""

    def verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sizes = np.array([len(s) for s in sets], np.int64)
        ok = (np.minimum(sizes[i], sizes[j]) > 0) & (np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9)
        at = np.flatnonzero(ok)
        out = np.full(len(i), -1.0)
        if len(at) > 4 * len(sets) and 16 < len(sets) <= 4 * BLOCK:
            return _dense(sets, sizes, i, j, ok, threshold)
        for p in at:
            a, b = sets[i[p]], sets[j[p]]
            if len(a) > len(b):
                a, b = b, a
            pos = np.searchsorted(b, a)
            pos[pos == len(b)] = 0
            both = int(np.count_nonzero(b[pos] == a))
            out[p] = both / (len(a) + len(b) - both)
        out[out < threshold - 1e-9] = -1
        return out

    return verify


def _dense(sets, sizes, i, j, ok, threshold):
    """Intersections of all members at once, by products of membership matrices, in slices of the vocabulary."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.empty(len(flat), bool)
    new[:1] = True
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    word = np.cumsum(new) - 1
    counts = np.bincount(word)
    shared = counts[word] > 1
    word, owner = word[shared], owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    if len(word):
        _, word = np.unique(word, return_inverse=True)
        width = 4096
        edges = np.searchsorted(word, np.arange(0, word[-1] + 1 + width, width))
        for n, (x, y) in enumerate(zip(edges, edges[1:])):
            if y > x:
                m = np.zeros((len(sets), width), np.float32)
                m[owner[x:y], word[x:y] - n * width] = 1
                both += m @ m.T
    common = np.rint(both[i, j]).astype(np.int64)
    similar = common / np.maximum(sizes[i] + sizes[j] - common, 1)
    return np.where(ok & (similar >= threshold - 1e-9), similar, -1.0)


def _pairs(rows: dict, unordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one task that this task must verify, as positions in its batch."""
    n, at = rows["n"], rows["at"]
    if rows["i"] != rows["j"]:
        part = rows["part"]
        left, right = np.flatnonzero(part == rows["i"]), np.flatnonzero(part == rows["j"])
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    elif n < len(_TRIANGLES):
        i, j = _TRIANGLES[n]
    else:
        i, j = np.triu_indices(n, 1)
    if not len(i):
        return i, j
    keys = rows["keys"]
    first = np.empty(len(i), bool)
    step = max(1, (1 << 20) // keys.shape[1] ** (2 if unordered else 1))
    for x in range(0, len(i), step):
        a, b = keys[i[x : x + step]], keys[j[x : x + step]]
        common = (a[:, :, None] == b[:, None, :]).any(2) if unordered else a == b
        first[x : x + step] = np.where(common, a, _LARGEST).min(1) == rows["key"]
        if rows["prev"] is not None:
            first[x : x + step] &= ~(rows["prev"][i[x : x + step]] == rows["prev"][j[x : x + step]]).any(1)
    return i[first] + at, j[first] + at


_TRIANGLES = [np.triu_indices(n, 1) for n in range(33)]


def _linked(i: np.ndarray, j: np.ndarray, ids: np.ndarray, weight: np.ndarray):
    """Rows (id, smallest id reached, weighted links) of the linked positions."""
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = back.reshape(2, -1)
    ids, weight = ids[used], weight[used]
    links = np.zeros(len(used), np.int64)
    for a, b in ((i, j), (j, i)):
        np.add.at(links, a, weight[b])
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(used), np.int64)
    label[order] = np.arange(len(used))
    while True:  # smallest label of the neighbours, until nothing changes
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = np.minimum(label, label[order[label]])
        if (label == before).all():
            return ids, ids[order[label]], links


_OUT = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _runner(verify: Verify, decode, with_prev: bool, unordered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(batch: pa.RecordBatch):
            """Whole tasks: rows sorted by task. Small tasks are verified together, large ones alone."""
            task = batch.column("task").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])) if len(task) else np.array([], int)
            ends = np.append(cut[1:], len(task))
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "weight", "part", "i", "j", "key")}
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64).reshape(len(task), -1) if len(task) else None
            prev = np.frombuffer(b"".join(batch.column("prev").to_pylist()), np.int64).reshape(len(task), -1) if with_prev and len(task) else None
            payload = batch.column("payload")
            small: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for x, y in zip(cut.tolist(), ends.tolist()):
                if y - x < 2:
                    continue
                rows = {"n": y - x, "at": x, "part": col["part"][x:y], "i": col["i"][x], "j": col["j"][x], "key": col["key"][x], "keys": keys[x:y], "prev": prev[x:y] if with_prev else None}
                i, j = _pairs(rows, unordered)
                if len(i) > 4096:
                    yield from check(i, j, col, payload)
                elif len(i):
                    small.append((i, j))
                    held += len(i)
                    if held > 20_000:
                        yield from check(*(np.concatenate([s[k] for s in small]) for k in (0, 1)), col, payload)
                        small, held = [], 0
            if small:
                yield from check(*(np.concatenate([s[k] for s in small]) for k in (0, 1)), col, payload)

        def check(i, j, col, payload):
            used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            back = back.reshape(2, -1)
            size = np.cumsum([payload[u].as_buffer().size for u in used.tolist()])
            if size[-1] > BYTES and len(used) > 2:
                part = np.minimum((size - 1) // (BYTES // 2), np.arange(len(used)))  # a member larger than a part is a part
                part = np.unique(part, return_inverse=True)[1]
                of = part[back]
                pairs = of.min(0) * (part[-1] + 1) + of.max(0)
                if pairs.min() != pairs.max():
                    for p in np.unique(pairs):
                        yield from check(i[pairs == p], j[pairs == p], col, payload)
                    return
            similar = verify(decode([payload[u].as_buffer() for u in used.tolist()]), back[0], back[1])
            ok = similar >= 0
            if ok.any():
                i, j, percent = i[ok], j[ok], np.floor(similar[ok] * 100 + 1e-6).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _linked(i, j, col["id"], col["weight"])], schema=_OUT)
                bins = np.unique(percent)
                pairs = [int((col["weight"][i] * col["weight"][j])[percent == b].sum()) for b in bins]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(bins), pa.int64()), pa.array(bins), pa.array(pairs, pa.int64())], schema=_OUT)

        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task").to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(task, task[-1]))  # where the last, perhaps open, task begins
            if held and held[0].column("task")[0].as_py() == task[-1]:
                held.append(batch)
                continue
            if last:
                held.append(batch.slice(0, last))
            for whole in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
                yield from done(whole)
            held = [batch.slice(last)]
        for whole in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
            yield from done(whole)

    return run


def _met(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Of one partition's rows (id, key, ...), those whose key another id has too; a row may come twice.

    Whenever `chunk` rows have gathered, the rows of keys that two ids share are given out and one of them is kept in
    their place. So the memory follows the number of different keys and not the rows of one key.
    """
    schema, held, fresh, kept = None, [], 0, 0

    def settle():
        """Rows to give out, and rows to keep: for a key without a second id that row, else one to mark the key."""
        columns = [np.concatenate([h[k] for h in held]) for k in range(len(held[0]))]
        order = np.argsort(columns[1])
        keys = columns[1][order]
        same = np.zeros(len(keys), bool)
        same[1:] = keys[1:] == keys[:-1]
        same[:-1] |= same[1:]
        alone = [c[order[~same]] for c in columns]
        order = order[same]
        order = order[np.lexsort((~columns[-1][order], columns[0][order], columns[1][order]))]  # of equal rows the mark first
        ids, keys, *_, mark = (c[order] for c in columns)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        order, keys, mark = order[new], keys[new], mark[new]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        sizes = np.diff(np.append(at, len(keys)))
        shared = (sizes > 1) | np.logical_or.reduceat(mark, at) if len(at) else np.zeros(0, bool)
        out = np.repeat(shared, sizes) & ~mark
        keep = [c[order[at]] for c in columns]
        keep[-1] = shared
        return [c[order[out]] for c in columns[:-1]], [np.concatenate([a, k]) for a, k in zip(alone, keep)]

    for b in batches:
        if not b.num_rows:
            continue
        schema = b.schema
        held.append([*(c.to_numpy(zero_copy_only=False) for c in b.columns), np.zeros(b.num_rows, bool)])
        fresh += b.num_rows
        if fresh >= max(chunk, kept):
            out, keep = settle()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=schema)
            held, fresh, kept = [keep], 0, len(keep[0])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in settle()[0]], schema=schema)


def meeting(spread: DataFrame, tag: str, once: bool = False) -> DataFrame:
    """The rows of spread (id long, key long, perhaps child long) whose key another id has too, once each, staged.

    once: no row of spread comes twice.
    """
    columns = [c for c in ("id", "key", "child") if c in spread.columns]
    met = spread.select(*columns).repartition("key").mapInArrow(_met, ", ".join(f"{c} long" for c in columns))
    return stage(met if once else met.distinct(), f"{tag}-met", compact=True)


def bucket_join(items: Callable[[DataFrame], DataFrame], verify: Verify, decode, met: DataFrame, tag: str, with_prev: bool = False, unordered: bool = False) -> DataFrame:
    """Links of items that share a key and pass verify, as partial rows (id, root, links).

    met: what meeting() returns. With a column child, a bucket whose rows have one child alone is left out: its
    pairs share the child, a longer key, and were joined there.
    items: gives, for a table of the ids that met another, id (unique), weight long, keys binary (the item's
    keys as int64; two items share a key only at the same position, unless unordered), payload
    binary, and prev binary: with_prev, pairs that share a key of prev at one position were joined before.
    decode: makes the objects verify compares from a list of payloads.
    The result is staged; links must be summed by id, and (id, root) are edges of a spanning forest. Rows with a null id
    count the linked pairs of a hundredth of similarity: root is the hundredth, links the pairs.
    """
    counted = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("f1"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("f2"), *([F.min("child").alias("lo"), F.max("child").alias("hi")] if "child" in met.columns else []))
    buckets = counted.where("lo <> hi") if "child" in met.columns else counted
    # Buckets with the same members are one. The smallest key stands for them: a pair is joined in the
    # bucket of its smallest common key.
    kept = buckets.groupBy("n", "f1", "f2").agg(F.min("key").alias("key")).select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    members = salted_join(met.select("id", "key"), kept, ["key"], "id", "n", total=met.count())
    members = stage(members.withColumn("part", F.pmod(F.xxhash64("id", F.lit(11)), F.col("nb")).cast("int")), f"{tag}-members", compact=True)
    unstage(met)
    dealt = members.select("id", "part", "key", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select("id", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "key")
    dealt = dealt.select("id", "part", "i", "j", "key", F.xxhash64("key", "i", "j").alias("task"))
    columns = ["task", "id", "weight", "part", "i", "j", "key", "keys", "payload"] + ["prev"] * with_prev
    ready = dealt.join(items(members.select("id").distinct()), "id").select(*columns).repartition("task").sortWithinPartitions("task")
    found = stage(ready.mapInArrow(_runner(verify, decode, with_prev, unordered), "id long, root long, links long"), f"{tag}-links", compact=True)
    unstage(members)
    return found


def connected_components(edges: DataFrame, tag: str, rounds: int = 60) -> DataFrame:
    """Distributed union-find: (id, component) for every id of edges (a, b); component is the smallest id reached.

    Alternates large-star and small-star steps; each round is staged, and nothing of it reaches the driver
    but a count and a checksum. An empty edge table gives an empty result.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{tag}-cc0", compact=True)
    mark = _mark(now)
    for k in range(1, rounds + 1):
        if mark[0] == 0:
            break
        both = now.union(now.select("v", "u"))
        # A root has a row for each member it meets: the joins deal its rows to many tasks.
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n").where("n > 0")
        large = salted_join(both.where("v > u"), low, ["u"], "v", "n", total=mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = salted_join(large, small_low, ["u"], "v", "n", total=mark[0])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(joined.select("u", F.col("m").alias("v"))).distinct()
        after = stage(small, f"{tag}-cc{k}", compact=True)
        seen, mark = mark, _mark(after)
        unstage(now)
        now = after
        if mark == seen:
            break
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head()
    return r.n, r.x
