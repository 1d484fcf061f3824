"""Iterative graph operators on edge tables. Every round is checkpointed, so lineage stays short and lost executors are harmless.

A round limit that is reached is an error: no operator returns a table that has not converged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_checkpoint_dir(spark) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, in local mode only."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp()
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def chain_ends(table: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth): the last row of each row's parent chain and the steps to it, by pointer doubling.

    A parent that is no key ends the chain before it. Rows whose chain runs into a cycle have no root: NULL, and depth NULL.
    """
    rows = table.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    there = rows.select(F.col("k").alias("p"), F.lit(1).cast("long").alias("d"))
    now = cut(rows.join(there, "p", "left").select("k", F.when(F.col("d").isNull(), F.col("k")).otherwise(F.col("p")).alias("r"), F.coalesce("d", F.lit(0).cast("long")).alias("d"), (F.coalesce("d", F.lit(0)) > 0).alias("moved")))
    # No chain without a cycle has more steps than there are rows.
    for _ in range(now.count().bit_length()):
        if now.where("moved").isEmpty():
            break
        ahead = now.select(F.col("k").alias("r"), F.col("r").alias("next"), F.col("d").alias("more"))
        now = cut(now.join(ahead, "r").select("k", F.col("next").alias("r"), (F.col("d") + F.col("more")).alias("d"), (F.col("more") > 0).alias("moved")))
    end = lambda c: F.when(~F.col("moved"), F.col(c))
    return now.select(F.col("k").alias(key), end("r").alias("root"), end("d").alias("depth"))


def chain_hits(table: DataFrame, key: str, parent: str, hit: str) -> DataFrame:
    """(key, hit): does hit hold in the row or in any row up its parent chain? By pointer doubling: a round doubles the steps that are seen.

    Keys occur once. A parent that is no key ends the chain before it; a row whose chain runs into a cycle sees all of the cycle.
    """
    seen = F.coalesce(F.col(hit), F.lit(False))
    now = cut(table.select(F.col(key).alias("k"), F.when(~seen, F.col(parent)).alias("p"), seen.alias("h")))
    # As many steps as there are rows have met every row that can be met.
    for _ in range(now.count().bit_length() + 1):
        if now.where("p is not null").isEmpty():
            break
        # Rows that are decided have no pointer; they are not joined, for all of them would meet in one task.
        ahead = now.select(F.col("k").alias("p"), F.col("p").alias("next"), F.col("h").alias("more"))
        met = now.where("p is not null").join(ahead, "p", "left").select("k", "next", F.coalesce("more", F.lit(False)).alias("h"))
        now = cut(met.select("k", F.when(~F.col("h"), F.col("next")).alias("p"), "h").unionAll(now.where("p is null")))
    return now.select(F.col("k").alias(key), F.col("h").alias(hit))


def chain_root(table: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root) of chain_ends()."""
    return chain_ends(table, key, parent).drop("depth")


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each connected component, by minimum labels and pointer jumping."""
    ends = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = cut(edges.select(F.inline(F.array(ends(a, b), ends(b, a)))).distinct())
    now = both.groupBy("u").agg(F.least("u", F.min("v")).alias("c"))
    now = cut(now.selectExpr("u as node", "c"))
    for _ in range(rounds):
        near = both.join(now.selectExpr("node as v", "c as w"), "v").groupBy("u").agg(F.min("w").alias("w"))
        low = now.join(near.selectExpr("u as node", "w"), "node").select("node", F.least("c", "w").alias("c"))
        after = cut(low.alias("x").join(low.selectExpr("node as c", "c as up"), "c", "left").select("node", F.least("c", F.coalesce("up", "c")).alias("c")))
        if after.join(now.selectExpr("node", "c as was"), "node").where("c <> was").isEmpty():
            break
        now = after
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    return now.select("node", F.col("c").alias("component"))


#: Edges from which closure() takes nodes without children apart.
PEEL = 100_000


def closure(edges: DataFrame, child: str, parent: str, rounds: int = 1000, peel: int = PEEL) -> DataFrame:
    """(child, ancestor): all ancestors.

    Nodes that are nobody's parent are most of a broad graph, and those with the same parents have the same ancestors. While
    they have half of the edges or more, the others are closed first, by the same function, and each set of parents is
    looked up once: a pair is then written and not joined. The rest goes by pairs, a generation a round.
    A row holds the ancestors of one node.
    """
    step = cut(edges.select(F.col(child).alias("x"), F.col(parent).alias("b")).where("x <> b").distinct())
    above = _peeled(step, rounds, peel)
    pairs = _generations(step, rounds) if above is None else above.select("c", F.explode("up").alias("a"))
    return pairs.select(F.col("c").alias(child), F.col("a").alias("ancestor"))


def _peeled(step: DataFrame, rounds: int, peel: int) -> DataFrame | None:
    """(c, up): the array of all ancestors of each node with edges (x, b); None where too few nodes are nobody's parent."""
    n = step.count()
    if n < max(peel, 1):
        return None
    parents = step.select(F.col("b").alias("x")).distinct()
    inner = cut(step.join(parents, "x", "left_semi"))
    if 2 * inner.count() > n:
        return None
    leaves = cut(step.join(parents, "x", "left_anti").groupBy("x").agg(F.array_sort(F.collect_set("b")).alias("s")))
    above = _peeled(inner, rounds, peel)
    if above is None:
        above = _generations(inner, rounds).groupBy("c").agg(F.collect_list("a").alias("up"))
    above = cut(above)
    each = leaves.select("s").distinct().select("s", F.explode("s").alias("c")).join(above, "c", "left")
    own = F.array("c")
    sets = each.groupBy("s").agg(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("up").isNull(), own).otherwise(F.concat(own, F.col("up")))))).alias("up"))
    return above.unionAll(leaves.join(sets, "s").select(F.col("x").alias("c"), "up"))


def _generations(step: DataFrame, rounds: int) -> DataFrame:
    """(c, a): all ancestors by edges (x, b), a generation a round; only pairs that are new go on, so cycles end by themselves.

    A generation joins with the direct edges alone: that meets a pair once for each way to it, where doubling
    would meet it once for each ancestor between.
    """
    now = fresh = step.select(F.col("x").alias("c"), F.col("b").alias("a"))
    for _ in range(rounds):
        grown = fresh.join(step, F.col("a") == F.col("x")).select("c", F.col("b").alias("a")).where("c <> a").distinct()
        fresh = cut(grown.join(now, ["c", "a"], "left_anti"))
        if fresh.isEmpty():
            break
        now = cut(now.union(fresh))
    else:
        raise RuntimeError(f"more than {rounds} generations")
    return now


def spanning_forest(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b, w) of a maximum spanning forest of edges (a, b, w), by Boruvka's rounds: each component takes the best edge that leaves it, and
    components joined in this way become one, by components().

    Of equal weights the edge with the smaller ends is better, so the order is strict and no cycle can close. Ends may be of any
    type that has an order. Loops, and edges without a weight or an end, are none. Of parallel edges between two components only the best goes on to the next round.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    known = edges.where("a is not null and b is not null and w is not null and not isnan(w) and a <> b").select(a.alias("a"), b.alias("b"), F.col("w").cast("double").alias("w"))
    live = cut(known.groupBy("a", "b").agg(F.max("w").alias("w")).select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct((-F.col("w")).alias("o"), "a", "b").alias("e")))
    tree = live.select("e").limit(0)
    for _ in range(rounds):
        if live.isEmpty():
            break
        both = live.select("u", "v", "e").union(live.select("v", "u", "e"))
        best = cut(both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", "m.v", "m.e"))
        tree = cut(tree.union(best.select("e")).distinct())
        label = components(best, "u", "v")
        ends = live.join(label.selectExpr("node as u", "component as cu"), "u").join(label.selectExpr("node as v", "component as cv"), "v").where("cu <> cv")
        live = cut(ends.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.min("e").alias("e")))
    else:
        raise RuntimeError(f"no forest in {rounds} rounds")
    return tree.select("e.a", "e.b", (-F.col("e.o")).alias("w"))


def weakest_links(edges: DataFrame) -> DataFrame:
    """(grp, nodes, weakest) of edges (grp, a, b, w): in each group, the tree of its maximum spanning forest that holds the group's smallest node: its nodes and its smallest edge."""
    named = edges.select(F.struct("grp", F.col("a").alias("node")).alias("a"), F.struct("grp", F.col("b").alias("node")).alias("b"), "w")
    forest = cut(spanning_forest(named))
    label = components(forest, "a", "b")
    first = label.groupBy("node.grp").agg(F.min(F.struct("node", "component")).alias("m")).select("grp", F.col("m.component").alias("component"))
    sizes = label.groupBy("component").agg(F.count("*").alias("nodes"))
    least = forest.join(label.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.min("w").alias("weakest"))
    return first.join(sizes, "component").join(least, "component").select("grp", "nodes", "weakest")
