"""Splits, folds, samples and permutations by hash order (R rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.operators.numbering import hash_ranks, row_ranks

from . import views as v
from .registry import query


def hash_order(seed: int | str, key: str) -> Column:
    """Order that any engine can repeat: the hash of seed and key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


@query("hash_split", "WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('1:' || c_custkey)) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey, CASE WHEN k < 0.6 * n THEN 'train' WHEN k < 0.8 * n THEN 'val1' ELSE 'val2' END AS part FROM r")
def hash_split(spark, sf_dir):
    """60/20/20 by hash order within strata."""
    c = v.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sizes = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    k, n = F.col("k") - 1, F.col("n")
    return hash_ranks(c, ["c_nationkey"], hash_order(1, "c_custkey"), "k").join(sizes, "c_nationkey").select("c_custkey", F.when(k < 0.6 * n, "train").when(k < 0.8 * n, "val1").otherwise("val2").alias("part"))


@query("gene_group_split", "WITH s AS (SELECT l_orderkey, max(CASE WHEN substr(sha256('2:' || l_partkey), 1, 1) < '8' THEN 0 WHEN substr(sha256('2:' || l_partkey), 1, 1) < 'c' THEN 1 ELSE 2 END)::INT AS part FROM lineitem GROUP BY 1) SELECT l_orderkey, part FROM s")
def gene_group_split(spark, sf_dir):
    """Genes are dealt to sets; a group goes to the most held-out set of its genes."""
    digit = F.substring(hash_order(2, "l_partkey"), 1, 1)
    return v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(digit < "8", 0).when(digit < "c", 1).otherwise(2)).alias("part"))


@query(
    "gene_group_seen",
    """WITH p AS (SELECT DISTINCT l_orderkey, l_partkey, CASE WHEN substr(sha256('2:' || l_partkey), 1, 1) < '8' THEN 0 WHEN substr(sha256('2:' || l_partkey), 1, 1) < 'c' THEN 1 ELSE 2 END AS part FROM lineitem),
g AS (SELECT l_orderkey, max(part) AS part, count(*) AS n, count(*) FILTER (part = 0) AS seen FROM p GROUP BY 1)
SELECT l_orderkey, CASE WHEN part = 0 AND n >= 2 AND substr(sha256('5:' || l_orderkey), 1, 1) < '4' THEN 1 ELSE part END::INT AS part, CASE WHEN n = 1 THEN 'single' ELSE 'combination_seen' || seen END AS category FROM g""",
)
def gene_group_seen(spark, sf_dir):
    """As gene_group_split; of the combinations whose genes are all in training a quarter is held out, by hash order, and each group has a category."""
    digit = F.substring(hash_order(2, "l_partkey"), 1, 1)
    p = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().withColumn("part", F.when(digit < "8", 0).when(digit < "c", 1).otherwise(2))
    g = p.groupBy("l_orderkey").agg(F.max("part").alias("part"), F.count("*").alias("n"), F.count_if(F.col("part") == 0).alias("seen"))
    out = (F.col("part") == 0) & (F.col("n") >= 2) & (F.substring(hash_order(5, "l_orderkey"), 1, 1) < "4")
    return g.select("l_orderkey", F.when(out, 1).otherwise(F.col("part")).alias("part"), F.when(F.col("n") == 1, "single").otherwise(F.concat(F.lit("combination_seen"), F.col("seen").cast("string"))).alias("category"))


@query("kfold_predict_hide", "WITH f AS (SELECT l_orderkey, list_sort(list_distinct(list((l_partkey % 5)::INT))) AS folds FROM lineitem GROUP BY 1) SELECT l_orderkey, folds[1] AS predict_fold, array_to_string(folds, ',') AS hidden_in FROM f")
def kfold_predict_hide(spark, sf_dir):
    """Predicted in its lowest gene fold, hidden in every fold that holds one of its genes."""
    folds = F.array_sort(F.collect_set((F.col("l_partkey") % 5).cast("int")))
    f = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(folds.alias("f"))
    return f.select("l_orderkey", F.col("f")[0].alias("predict_fold"), F.array_join(F.col("f").cast("array<string>"), ",").alias("hidden_in"))


@query("disjoint_controls", "WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('3:' || o_orderkey)) AS k FROM orders) SELECT o_orderkey, CASE WHEN k <= 100 THEN 'public' ELSE 'evaluation' END AS sample FROM r WHERE k <= 150")
def disjoint_controls(spark, sf_dir):
    """Two disjoint samples of fixed size a stratum, by hash order (sampling is the feature)."""
    o = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return hash_ranks(o, ["o_orderpriority"], hash_order(3, "o_orderkey"), "k").where("k <= 150").select("o_orderkey", F.when(F.col("k") <= 100, "public").otherwise("evaluation").alias("sample"))


@query(
    "perm_within_bins",
    "WITH b AS (SELECT p_partkey, p_size // 10 AS bin FROM part), a AS (SELECT p_partkey, bin, row_number() OVER (PARTITION BY bin ORDER BY p_partkey) AS i, row_number() OVER (PARTITION BY bin ORDER BY sha256('4:' || p_partkey)) AS j FROM b) SELECT x.p_partkey, y.p_partkey AS mapped FROM a x JOIN a y ON y.bin = x.bin AND y.j = x.i",
)
def perm_within_bins(spark, sf_dir):
    """A permutation within bins: position by id takes the member at the same position by hash."""
    b = v.table(spark, sf_dir, "part").select("p_partkey", F.expr("p_size div 10").alias("bin"))
    by_id = row_ranks(b, ["bin"], "p_partkey", "p_partkey", "i")
    by_hash = hash_ranks(b, ["bin"], hash_order(4, "p_partkey"), "i").withColumnRenamed("p_partkey", "mapped")
    return by_id.join(by_hash, ["bin", "i"]).select("p_partkey", "mapped")


@query("half_sample", "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('5:' || c_custkey)) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey FROM r WHERE k <= n // 2")
def half_sample(spark, sf_dir):
    """Half of each group by hash order."""
    c = v.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    sizes = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return hash_ranks(c, ["c_mktsegment"], hash_order(5, "c_custkey"), "k").join(sizes, "c_mktsegment").where("k <= n div 2").select("c_custkey")


@query("context_views", f"WITH {v.DELTA} SELECT fold, count(*) AS n, round(avg(delta), 6) AS mean FROM delta, (SELECT unnest(range(5))::INT AS fold) WHERE pert % 5 <> fold GROUP BY 1")
def context_views(spark, sf_dir):
    """The training view less each fold."""
    d = v.delta_view(spark, sf_dir).select("pert", "delta", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")).where("pert % 5 <> fold")
    return d.groupBy("fold").agg(F.count("*").alias("n"), v.r6(F.avg("delta")).alias("mean"))
