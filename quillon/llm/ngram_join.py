"""N-gram Jaccard join by a MinHash LSH forest (operator 9).

Every text becomes its set of five-word shingles. Its MinHash values are its paths through TREES prefix tries of
DEPTH levels. A trie is held by the hashes of its nodes, level by level, dealt and sorted by node; texts
below one node are candidates. The join starts from the whole signatures and shortens the matched prefixes
step by step. At each step only nodes that branch since the last one bring new pairs, and only pairs that no longer
prefix has matched are verified, by the exact Jaccard similarity of their whole shingle sets.

After each step the recall is estimated from the links found so far: those of the lowest stratum of similarity (STRATUM
above the threshold), which are lost most easily, each weighed by the inverse of its chance to be met at that depth.
The shortening ends where the estimate reaches the target; else the next depth is the longest one at which these links
would reach it. As long as that stratum has shown no link, the estimate is the chance of a pair at the
threshold itself. A join has no number of neighbours after which a text could stop, so all texts shorten together.

Defined cases: words are runs of non-white characters, lower-cased. Texts with equal words are one
class and linked with each other. 1 to 4 words make one shingle. A null or empty text, and a row with
a null id, links with nothing and is kept. Repeated rows are copies. An id that repeats with another text gives a row
for each, with that text's links. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, distinct, fold, minhash_rows, release, salted_join, stage, table, unstage, word_shingles
from ._simjoin import bucket_join, connected_components, jaccard_verify, meeting

TREES, DEPTH, WORDS, THRESHOLD, TARGET, STRATUM, SEED = 16, 8, 5, 0.8, 0.998, 0.05, 20260


def recall_at(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that two texts of this similarity share a prefix of this depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def estimate(links: Counter, depth: int, trees: int, threshold: float) -> float:
    """Recall at a depth, from the number of links in each hundredth of similarity (counted at its lower bound)."""
    near = {k / 100: n for k, n in links.items() if n and k / 100 < threshold + STRATUM - 1e-9}
    if not near:
        return recall_at(threshold, depth, trees)
    return sum(near.values()) / sum(n / recall_at(max(s, threshold), depth, trees) for s, n in near.items())


def _words(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _texts(column: pa.Array) -> list[str]:
    return [_words(t) for t in column.to_pylist()]


def _signer(trees: int, depth: int, words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("txt", pa.int64()), ("cls", pa.int64()), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, txt = batch.column("doc_id"), batch.column("txt")
            raw = batch.column("text")
            for lo in range(0, batch.num_rows, 512):
                part = _texts(raw.slice(lo, 512))
                cls = [struct.unpack("<q", hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[:8])[0] if t else None for t in part]
                sigs: list[bytes] = []
                for x, y in chunks(part):
                    h, counts = word_shingles(part[x:y], words)
                    sigs += [s.tobytes() for s in minhash_rows(h, counts, trees * depth, SEED)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 512), txt.slice(lo, 512), pa.array(cls, pa.int64()), pa.array(sigs, pa.binary())], schema=schema)

    return sign


def _nodes(sig: list[bytes], trees: int, depth: int, prefix: int) -> np.ndarray:
    """The trie nodes of signatures at a depth, one a tree."""
    m = np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), trees, depth)
    return np.stack([fold(m[:, t, :prefix], t + 1) for t in range(trees)], axis=1)


def _node_maker(trees: int, depth: int, prefix: int, before: int):
    """Rows (id, key, child): a node of the depth `prefix` and the node of the depth `before` below it; beyond the last level that is the text itself."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("child", pa.int64())])

    def make(batches):
        for b in batches:
            if b.num_rows:
                sig = b.column("sig").to_pylist()
                ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), trees)
                child = _nodes(sig, trees, depth, before).ravel() if before <= depth else ids
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, _nodes(sig, trees, depth, prefix).ravel(), child)], schema=schema)

    return make


def _set_maker(words: int):
    schema = pa.schema([("id", pa.int64()), ("weight", pa.int64()), ("sig", pa.binary()), ("payload", pa.binary())])

    def make(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                c = b.slice(lo, 256)
                texts = _texts(c.column("text"))
                sets: list[bytes] = []
                for x, y in chunks(texts):
                    h, counts = word_shingles(texts[x:y], words)
                    sets += [distinct(s).tobytes() for s in np.split(h, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([c.column("id"), c.column("weight"), c.column("sig"), pa.array(sets, pa.binary())], schema=schema)

    return make


def _keyed(trees: int, depth: int, prefix: int, before: int):
    schema = pa.schema([("id", pa.int64()), ("weight", pa.int64()), ("keys", pa.binary()), ("payload", pa.binary()), ("prev", pa.binary())])

    def make(batches):
        for b in batches:
            if b.num_rows:
                sig = b.column("sig").to_pylist()
                both = [pa.array([k.tobytes() for k in _nodes(sig, trees, depth, p)] if p <= depth else [b""] * len(sig), pa.binary()) for p in (prefix, before)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("weight"), both[0], b.column("payload"), both[1]], schema=schema)

    return make


def _decode(buffers) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in buffers]


def _joined(docs: DataFrame, threshold: float, words: int, trees: int, depth: int, target: float, levels: list | None) -> DataFrame:
    """A row for every row of docs (doc_id, text): doc_id, txt (hash of the text), cls, class_id, n_links, component_id, and
    stays: whether the row has the first id, and of that the first text, of the first class of its component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("txt"))
    sigs = stage(docs.mapInArrow(_signer(trees, depth, words), "doc_id long, txt long, cls long, sig binary"), "op9-sig")
    live = sigs.where("doc_id is not null and cls is not null")
    classes = live.groupBy("cls").agg(F.min(F.struct("doc_id", "txt")).alias("first"), F.count("*").alias("weight"))
    classes = stage(classes.select("cls", F.col("first.doc_id").alias("class_id"), F.col("first.txt").alias("class_txt"), "weight"), "op9-classes", compact=True)
    # One row of each class; of repeated rows, one.
    own = (live.cls == classes.cls) & (live.doc_id == classes.class_id) & (live.txt == classes.class_txt)
    reps = stage(live.join(classes, own).select(classes.cls.alias("id"), "weight", "class_id", "class_txt", "sig").dropDuplicates(["id"]), "op9-reps", compact=True)

    def nodes(signed: DataFrame, prefix: int, before: int) -> DataFrame:
        return meeting(signed.select("id", "sig").mapInArrow(_node_maker(trees, depth, prefix, before), "id long, key long, child long"), "op9", once=True)

    # The texts that the join can come to need: those that meet another at the depth where even a pair at the threshold is met.
    floor = next((p for p in range(depth, 1, -1) if recall_at(threshold, p, trees) >= target), 1)
    ids = nodes(reps, floor, depth + 1).select("id").distinct()
    wanted = reps.join(ids, "id", "left_semi").select("id", "weight", "sig", F.col("class_id").alias("doc_id"), F.col("class_txt").alias("txt"))
    sets = stage(docs.join(wanted.hint("shuffle_hash"), ["doc_id", "txt"]).select("id", "weight", "sig", "text").dropDuplicates(["id"]).mapInArrow(_set_maker(words), "id long, weight long, sig binary, payload binary"), "op9-sets", compact=True)
    unstage(reps)
    found, seen, prefix, before = None, Counter(), depth, depth + 1
    while True:
        items = lambda _, p=prefix, b=before: sets.mapInArrow(_keyed(trees, depth, p, b), "id long, weight long, keys binary, payload binary, prev binary")
        links = bucket_join(items, jaccard_verify(threshold), _decode, nodes(sets, prefix, before), "op9", with_prev=before <= depth)
        release(docs.sparkSession)
        found = links if found is None else found.union(links)
        here = {r.root: r.n for r in links.where("id is null").groupBy("root").agg(F.sum("links").alias("n")).collect()}  # a row a hundredth
        seen.update(here)
        if levels is not None:
            levels.append((prefix, sum(here.values()), estimate(seen, prefix, trees, threshold)))
        if prefix == floor or estimate(seen, prefix, trees, threshold) >= target:
            break
        prefix, before = next((p for p in range(prefix - 1, floor, -1) if estimate(seen, p, trees, threshold) >= target), floor), prefix
    unstage(sets)
    found = found.where("id is not null")
    by_class = found.groupBy(F.col("id").alias("cls")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "op9").withColumnRenamed("id", "cls")
    per = classes.join(by_class, "cls", "left").join(groups, "cls", "left")
    per = stage(per.select("cls", "class_id", "class_txt", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"), "weight"), "op9-per", compact=True)
    smallest = per.groupBy("component").agg(F.min(F.struct("class_id", "cls")).alias("least"), F.count("*").alias("n"))
    per = salted_join(per, smallest, ["component"], "cls", "n", total=per.count()).select("cls", "class_id", "class_txt", "n_links", F.col("least.class_id").alias("component_id"), (F.col("least.cls") == F.col("cls")).alias("first"), "weight")
    per = stage(per, "op9-classed", compact=True)
    stays = F.col("first") & (F.col("doc_id") == F.col("class_id")) & (F.col("txt") == F.col("class_txt"))
    linked = salted_join(live.select("doc_id", "txt", "cls"), per, ["cls"], "doc_id", "weight").select("doc_id", "txt", "cls", "class_id", "n_links", "component_id", stays.alias("stays"))
    own = F.col("doc_id")
    alone = sigs.where("doc_id is null or cls is null").select(own, "txt", F.lit(None).cast("long").alias("cls"), own.alias("class_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("stays"))
    return linked.unionAll(alone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, target: float = TARGET, levels: list | None = None) -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept) for every row of docs (doc_id, text).

    class_id: smallest doc_id with the same words. n_links: other documents of similarity >= threshold,
    copies included. component_id: smallest doc_id that links reach. kept: doc_id = component_id.
    levels: if given, gets (depth, links found there, estimated recall) of each depth.
    """
    rows = _joined(docs, threshold, words, trees, depth, target, levels)
    return rows.select("doc_id", "class_id", "n_links", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> DataFrame:
    """docs without near duplicates: of each group of linked documents, the row of the smallest id stays.

    A group is one of texts: of rows that share an id, each belongs to the group of its own text. Rows that link
    with nothing, because the id is null or the text is null or empty, all stay. Columns pass through.
    """
    rows = _joined(docs, threshold, words, trees, depth, target, None)
    stay = rows.where("stays and doc_id is not null").select(F.col("doc_id").alias("_quillon_id"), F.col("txt").alias("_quillon_txt"), F.col("cls").isNull().alias("_quillon_all")).distinct()
    kept = docs.join(stay, (docs["doc_id"].cast("long") == stay["_quillon_id"]) & (F.xxhash64(docs["text"]) == stay["_quillon_txt"]))
    # Of repeated rows one stays, unless they have no words.
    kept = kept.withColumn("_quillon_row", F.when(~F.col("_quillon_all"), 0).otherwise(F.monotonically_increasing_id())).dropDuplicates(["_quillon_id", "_quillon_txt", "_quillon_row"])
    return kept.select(*(docs[c] for c in docs.columns)).unionByName(docs.where(docs["doc_id"].cast("long").isNull()))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
