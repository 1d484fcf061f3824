"""Sinks and sources of datasets: bundles with parts and hashes, public exports, model packages, merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bundle(profiles: DataFrame, split: DataFrame, path: str) -> DataFrame:
    """Write (pert, gene, mean) by the part of the split (pert, part); an empty part is refused. Returns the manifest."""
    sizes = {r.part: r.n for r in split.groupBy("part").agg(F.count("*").alias("n")).collect()}  # three parts
    empty = [p for p in ("train", "val1", "val2") if not sizes.get(p)]
    if empty:
        raise ValueError(f"empty parts: {empty}")
    rows = profiles.join(split, "pert")
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/profiles")
    written = profiles.sparkSession.read.parquet(f"{path}/profiles")
    manifest = written.groupBy("part").agg(F.count_distinct("pert").alias("perts"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("pert", "gene", "mean")).alias("digest"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return profiles.sparkSession.read.parquet(f"{path}/manifest")


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Parts whose rows no longer match the manifest."""
    rows = spark.read.parquet(f"{path}/profiles").groupBy("part").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("pert", "gene", "mean")).alias("digest"))
    kept = spark.read.parquet(f"{path}/manifest").select("part", F.col("rows").alias("r"), F.col("digest").alias("d"))
    return kept.join(rows, "part", "full_outer").where("not (rows <=> r and digest <=> d)").select("part")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, made: str, dest: str) -> None:
    """Put a finished folder in the place of another; a reader finds the old one or the new one, never a part."""
    (new, fs), (old, _), (aside, _) = _files(spark, made), _files(spark, dest), _files(spark, f"{made}-old")
    if fs.exists(old):
        fs.rename(old, aside)
    fs.mkdirs(old.getParent())
    if not fs.rename(new, old):
        raise OSError(f"{made} could not be moved to {dest}")
    fs.delete(aside, True)


def export_public(spark: SparkSession, path: str, dest: str) -> str:
    """Only the training part, and the manifest without digests. Returns 'unchanged' where dest holds these rows already, else 'written'.

    Written beside dest and moved there when it is whole. A folder that is no bundle is refused.
    """
    for part in ("profiles", "manifest"):
        p, fs = _files(spark, f"{path}/{part}")
        if not fs.exists(p):
            raise ValueError(f"{path} has no {part}")
    rows = spark.read.parquet(f"{path}/profiles").where("part = 'train'").drop("part")
    manifest = spark.read.parquet(f"{path}/manifest").where("part = 'train'").drop("digest")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("pert", "gene", "mean"))).head()
    old, fs = _files(spark, f"{dest}/profiles")
    if fs.exists(old) and mark(spark.read.parquet(f"{dest}/profiles")) == mark(rows):
        return "unchanged"
    made = f"{dest.rstrip('/')}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{made}/profiles")
    manifest.write.parquet(f"{made}/manifest")
    _replace(spark, made, dest)
    return "written"


def export_training(matrix: DataFrame, split: DataFrame, path: str) -> DataFrame:
    """The cells of the training groups and of the control, for another model; returns the receipt (kind, perts, rows, digest) with the groups held out."""
    rows = matrix.join(split.where("part = 'train'").select("pert"), "pert", "left_semi")
    rows.write.mode("overwrite").parquet(f"{path}/cells")
    digest = F.bit_xor(F.xxhash64("cell", "pert", "gene", "cnt")).alias("digest")
    made = matrix.sparkSession.read.parquet(f"{path}/cells").agg(F.lit("cells").alias("kind"), F.count_distinct("pert").alias("perts"), F.count("*").alias("rows"), digest)
    held = split.where("part <> 'train'").agg(F.lit("held out").alias("kind"), F.count("*").alias("perts"), F.lit(0).cast("long").alias("rows"), F.lit(None).cast("long").alias("digest"))
    made.unionByName(held).write.mode("overwrite").parquet(f"{path}/receipt")
    return matrix.sparkSession.read.parquet(f"{path}/receipt")


def with_knowledge(spark: SparkSession, path: str, knowledge: DataFrame, dest: str) -> DataFrame:
    """A copy of a bundle with the same labels and other knowledge; fails if the copy's labels differ. Returns its knowledge."""
    rows = spark.read.parquet(f"{path}/profiles")
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{dest}/profiles")
    spark.read.parquet(f"{path}/manifest").write.mode("overwrite").parquet(f"{dest}/manifest")
    knowledge.write.mode("overwrite").parquet(f"{dest}/knowledge")
    bad = [r.part for r in verify_bundle(spark, dest).collect()]  # three parts at most
    if bad:
        raise ValueError(f"labels changed: {bad}")
    return spark.read.parquet(f"{dest}/knowledge")


def kept(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; where it is absent it is built, written and read back."""
    p, fs = _files(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: columns of new win where they are not NULL; keys of both sides stay."""
    n = new.select(*(F.col(c).alias(f"_n_{c}") for c in new.columns))
    joined = old.join(n, F.col(key) == F.col(f"_n_{key}"), "full_outer")
    return joined.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns))


def write_package(coefficients: DataFrame, path: str) -> None:
    """Frozen model: member, column, mean, scale, coef, with a digest of each member."""
    coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")
    digest = F.bit_xor(F.xxhash64("column", "mean", "scale", "coef")).alias("digest")
    coefficients.groupBy("member").agg(digest, F.count("*").alias("columns")).write.mode("overwrite").parquet(f"{path}/digests")


def load_package(spark: SparkSession, path: str) -> DataFrame:
    """The coefficients; a member that does not match its digest fails the read."""
    rows = spark.read.parquet(f"{path}/coefficients")
    digest = F.bit_xor(F.xxhash64("column", "mean", "scale", "coef")).alias("digest")
    now = rows.groupBy("member").agg(digest, F.count("*").alias("columns"))
    kept = spark.read.parquet(f"{path}/digests").withColumnsRenamed({"digest": "d", "columns": "c"})
    bad = [r.member for r in kept.join(now, "member", "full_outer").where("not (digest <=> d and columns <=> c)").select("member").collect()]
    if bad:
        raise ValueError(f"members changed: {bad}")
    return rows


def layered(base: dict, over: dict) -> dict:
    """Settings: nested dictionaries of over replace those of base."""
    out = dict(base)
    for k, value in over.items():
        out[k] = layered(out[k], value) if isinstance(value, dict) and isinstance(out.get(k), dict) else value
    return out
