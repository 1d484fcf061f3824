"""Helpers shared by the training-data operators: scratch tables and hashing kernels."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd base of the polynomial span hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset a temporary folder serves, in local mode only; on a cluster this is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


#: Files a core of a staged table that is compact.
FILES = 8


def stage(df: DataFrame, tag: str, compression: str = "zstd", compact: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. compact: for tables of a few integers
    a row, written after a shuffle, whose partitions are merged down to FILES a core of the cluster.
    """
    spark = df.sparkSession
    if compact:
        df = df.coalesce(FILES * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/quillon/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], spread_by: str, weight: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """large joined with small, which has one row a key and in `weight` the number of rows of large with that key.

    The rows of a key that has more than half a task's fair share are dealt to as many tasks as it has such
    halves; so a key may hold any part of large. Fewer than two keys a shuffle partition can have that many
    rows: the list of them is broadcast. small is read twice, and a third time where its total weight is not given.
    """
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total is None:
        total = small.agg(F.sum(weight).alias("n")).head().n or 0
    share = total // (2 * parts) + 1
    salts = F.ceil(F.col(weight) / share).cast("int")
    hot = small.where(F.col(weight) > share).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), salts.alias("_salts"))
    a = large.join(F.broadcast(hot), [large[k] == hot[f"_hot_{k}"] for k in keys], "left")
    a = a.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts", *(f"_hot_{k}" for k in keys))
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(weight)
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now, not at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def unstage(df: DataFrame) -> None:
    """Delete the files of a table that stage() returned, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quillon/" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the span hashes over all 64 bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of units[starts[i]:ends[i]], from prefix sums of a polynomial."""
    up, down = powers(len(units) + 1)
    prefix = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[: len(units)], out=prefix[1:])
    length = (ends - starts).astype(np.uint64)
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + length * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """span_hashes of all windows units[i:i + n]."""
    up, down = powers(len(units) + 1)
    prefix = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[: len(units)], out=prefix[1:])
    h = prefix[n:] - prefix[:-n]
    h *= down[: len(h)]
    h += np.uint64(n * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return mix64(h)


def seeds(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)


def minhash(h: np.ndarray, starts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k minima for each run of shingle hashes h[starts[i]:starts[i + 1]]; runs are not empty.

    The k orders are products of the upper hash halves with odd numbers modulo 2**32. Runs are taken in
    slices that fit the processor's cache; a run longer than a slice is a slice of its own.
    """
    factors = seeds(k, seed)
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), k), np.uint32)
    step = 1 << 14
    cuts = [0]
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + step))))
    for lo, hi in zip(cuts, cuts[1:]):
        x, y = starts[lo], starts[hi] if hi < len(starts) else len(low)
        part, runs = low[x:y], starts[lo:hi] - x
        product = np.empty(len(part), np.uint32)
        for j in range(k):
            np.multiply(part, factors[j], out=product)
            out[lo:hi, j] = np.minimum.reduceat(product, runs)
    return out


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values (faster than numpy.unique on short arrays)."""
    h = np.sort(h)
    keep = np.empty(len(h), bool)
    keep[:1] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def fold(sig: np.ndarray, salt: int) -> np.ndarray:
    """One signed 64-bit key for each row of a matrix of 32-bit values."""
    h = np.full(len(sig), salt * 2 + 1, np.uint64) * np.uint64(BASE)
    for j in range(sig.shape[1]):
        h = mix64(h ^ sig[:, j].astype(np.uint64)) + np.uint64(j + 1)
    return h.view(np.int64)


def chunks(texts: list[str], most: int = 1 << 18):
    """Ranges of texts of at most `most` characters together; a longer text is a range of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def word_shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles of texts, and the number of each text's shingles.

    texts hold words with one space between them (no other white space). A text of 1 to n - 1 words
    has one shingle, all of it; an empty text has none.
    """
    units = np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero((units == 32) | (units == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = np.concatenate([[0], np.cumsum(units[ends[:-1]] == 10)]) if len(ends) else np.zeros(0, np.int64)
    real = ends > starts
    starts, ends, doc = starts[real], ends[real], doc[real]
    words = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    counts = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    which = np.repeat(np.arange(len(texts)), counts)
    begin = first[which] + np.arange(at[-1]) - at[:-1][which]
    last = np.minimum(begin + n - 1, first[which] + words[which] - 1)
    return span_hashes(units, starts[begin], ends[last]), counts


def minhash_rows(hashes: np.ndarray, counts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """minhash() for runs of counts[i] hashes each; runs without hashes get zeros."""
    out = np.zeros((len(counts), k), np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
        out[full] = minhash(hashes, begins, k, seed)
    return out
