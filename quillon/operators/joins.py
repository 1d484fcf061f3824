"""Join operators that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strict_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of tables with the same keys, once each; any other key, NULL among them, and any repeated one fails the query."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full_outer")
    both = both.withColumn("_n", F.count("*").over(Window.partitionBy(key)))  # dealt by the key already
    name = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    wrong = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.concat(F.lit("key on one side only: "), name))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key more than once: "), name)))
    return both.where(wrong.cast("string").isNull()).drop("_l", "_r", "_n")


def priority_lookup(labels: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """labels (raw) with col: of names (name, col) by exact name, alias (alias, name), then both without case."""
    by_alias = aliases.join(names, "name").groupBy("alias").agg(F.min("col").alias("col"))
    fold = lambda df, c: df.groupBy(F.lower(c).alias("k")).agg(F.min("col").alias("col"))
    steps = [(names.selectExpr("name as k", "col"), F.col("raw")), (by_alias.selectExpr("alias as k", "col"), F.col("raw")), (fold(names, "name"), F.lower("raw")), (fold(by_alias, "alias"), F.lower("raw"))]
    out = labels
    for n, (side, key) in enumerate(steps):
        out = out.join(side.select(F.col("k").alias(f"_k{n}"), F.col("col").alias(f"_c{n}")), key == F.col(f"_k{n}"), "left")
    return out.withColumn("col", F.coalesce(*(F.col(f"_c{n}") for n in range(4)))).drop(*(f"_{x}{n}" for n in range(4) for x in "kc"))


def jaccard_of_members(members: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b, jaccard) of groups that share a member; members are distinct (group, member) rows."""
    m = members.select(F.col(group).alias("a"), F.col(member).alias("x"))
    sizes = m.groupBy("a").agg(F.count("*").alias("n"))
    shared = m.join(m.selectExpr("a as b", "x"), "x").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    out = shared.join(sizes, "a").join(sizes.selectExpr("a as b", "n as m"), "b")
    return out.select("a", "b", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("jaccard"))


def interval_neighbours(points: DataFrame, reach: int, close: int) -> DataFrame:
    """(id, near, opposite, nearest) of points (id, chrom, pos, strand): other points within reach.

    Positions are binned by reach, so that a point meets its own and the two adjoining bins only.
    """
    own = points.select("id", "chrom", "pos", "strand", F.explode(F.array(*(F.floor(F.col("pos") / reach) + k for k in (-1, 0, 1)))).alias("bin"))
    other = points.select(F.col("id").alias("oid"), "chrom", F.col("pos").alias("opos"), F.col("strand").alias("ostrand"), F.floor(F.col("pos") / reach).alias("bin"))
    gap = F.abs(F.col("pos") - F.col("opos"))
    met = own.join(other, ["chrom", "bin"]).where((F.col("id") != F.col("oid")) & (gap <= reach))
    found = met.groupBy("id").agg(F.count("*").alias("near"), F.count_if((F.col("strand") != F.col("ostrand")) & (gap <= close)).alias("opposite"), F.min(gap).alias("nearest"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("opposite", F.lit(0)).alias("opposite"), "nearest")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """left with the last value of right at or before its time, by a union and a running last value (no range join)."""
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(*by, at, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def nearest_lists(points: DataFrame, reach: int, most: int = 20, block: int = 10_000) -> DataFrame:
    """(id, nearest, list) of points (id, chrom, pos): the distance to the nearest other point of the chromosome at any distance (NULL if there is none), and the ids of
    the `most` nearest within reach, by distance and id.

    Positions are ranked and dealt to blocks of consecutive ones, each with the `most` positions before and after it from its neighbours: no
    point lies beyond these in its list. Of the points at one position the first `most` + 1 ids are enough. A position may hold any part of the points.
    """
    from .graph import cut
    from .numbering import value_ranks

    known = points.select("id", "chrom", F.col("pos").cast("long").alias("pos"))
    placed = known.where("chrom is not null and pos is not null")
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = lambda c: F.slice(F.array_sort(c), 1, most + 1)
    part = salted.groupBy("chrom", "pos", "salt").agg(few(F.collect_list("id")).alias("ids"))
    places = cut(part.groupBy("chrom", "pos").agg(few(F.flatten(F.collect_list("ids"))).alias("ids")))
    ranks = value_ranks(places.select("chrom", "pos"), ["chrom"], "pos").select("chrom", "pos", (F.col("n_upto") - 1).cast("long").alias("rank"))
    places = places.join(ranks, ["chrom", "pos"])
    own, at = F.floor(F.col("rank") / block), F.col("rank") % block
    span = -(-most // block)  # a block may be smaller than a list
    near = places.withColumn("b", F.explode(F.sequence(F.greatest(own - F.when(at < most, span).otherwise(0), F.lit(0)), own + F.when(at >= block - most, span).otherwise(0))))
    around = Window.partitionBy("chrom", "b").orderBy("rank").rowsBetween(-most, most)
    met = near.withColumn("around", F.collect_list(F.struct("pos", "ids")).over(around)).where(own == F.col("b")).select("chrom", "pos", "around")
    joined = placed.join(met, ["chrom", "pos"])
    others = F.flatten(F.transform("around", lambda p: F.transform(p["ids"], lambda i: F.struct(F.abs(p["pos"] - F.col("pos")).alias("gap"), i.alias("id")))))
    others = F.array_sort(F.filter(others, lambda o: o["id"] != F.col("id")))
    found = joined.select("id", others.alias("o")).select("id", F.get("o", F.lit(0))["gap"].alias("nearest"), F.slice(F.filter("o", lambda o: o["gap"] <= reach), 1, most).alias("o"))
    found = found.select("id", "nearest", F.transform("o", lambda o: o["id"]).alias("list"))
    return found.unionByName(known.where("chrom is null or pos is null").select("id", F.lit(None).cast("long").alias("nearest"), F.array().cast(found.schema["list"].dataType).alias("list")))
