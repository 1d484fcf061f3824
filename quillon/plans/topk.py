"""Sorts, limits, top-k and set operations (T and U rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import views as v
from .registry import query


@query("de_top20", f"WITH {v.DELTA}, s AS (SELECT pert, gene, abs(delta) * 10 + 1e-6 * abs(ln((exp(mean) - 1 + 1e-9) / (exp(control_mean) - 1 + 1e-9))) AS score FROM delta) SELECT pert, gene, r FROM (SELECT *, row_number() OVER (PARTITION BY pert ORDER BY round(score, 9) DESC, gene) AS r FROM s) WHERE r <= 20")
def de_top20(spark, sf_dir):
    """Rank by score plus a small multiple of the fold change, stable on ties."""
    lfc = F.abs(F.ln((F.exp("mean") - 1 + 1e-9) / (F.exp("control_mean") - 1 + 1e-9)))
    score = F.abs("delta") * 10 + 1e-6 * lfc
    s = v.delta_view(spark, sf_dir).select("pert", "gene", F.round(score, 9).alias("score"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("pert").orderBy(F.desc("score"), "gene")).cast("long")).where("r <= 20").drop("score")


@query("delta_topk", f"WITH {v.DELTA} SELECT pert, gene, round(delta, 6) AS delta, r FROM (SELECT *, row_number() OVER (PARTITION BY pert ORDER BY round(abs(delta), 9) DESC, gene) AS r FROM delta) WHERE r <= 20")
def delta_topk(spark, sf_dir):
    """T02."""
    s = v.delta_view(spark, sf_dir)
    r = F.row_number().over(Window.partitionBy("pert").orderBy(F.round(F.abs("delta"), 9).desc(), "gene")).cast("long")
    return s.select("pert", "gene", v.r6("delta").alias("delta"), r.alias("r")).where("r <= 20")


@query(
    "knn_transfer",
    f"""WITH {v.DELTA}, w AS (SELECT a.pert AS a, b.pert AS b, round({v.sql_pearson('a.delta', 'b.delta')}, 9) AS w FROM delta a JOIN delta b ON a.gene = b.gene AND a.pert <> b.pert GROUP BY 1, 2),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM w WHERE w > 0) WHERE r <= 5)
SELECT k.a AS pert, d.gene, round(sum(w * d.delta) / sum(w), 6) AS pred FROM k JOIN delta d ON d.pert = k.b GROUP BY 1, 2""",
)
def knn_transfer(spark, sf_dir):
    """Weighted mean of the five most similar groups of positive weight."""
    from quillon.operators.linear import group_correlations

    d = v.delta_view(spark, sf_dir).select("pert", "gene", "delta")
    w = group_correlations(d).select(F.col("p").alias("a"), F.col("q").alias("b"), F.round("r", 9).alias("w"))
    k = w.where("w > 0").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).where("r <= 5")
    return k.join(d.withColumnRenamed("pert", "b"), "b").groupBy(F.col("a").alias("pert"), "gene").agg(v.r6(F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("pred"))


@query("hvg_union_targets", "WITH s AS (SELECT p_brand AS gene, var_pop(p_retailprice) AS x FROM part GROUP BY 1), t AS (SELECT gene FROM (SELECT gene, row_number() OVER (ORDER BY round(x, 6) DESC, gene) AS r FROM s) WHERE r <= 8) SELECT gene FROM t UNION SELECT p_brand FROM part WHERE p_size = 50")
def hvg_union_targets(spark, sf_dir):
    """The most variable measures and all targets."""
    part = v.table(spark, sf_dir, "part")
    top = part.groupBy(F.col("p_brand").alias("gene")).agg(F.round(F.var_pop("p_retailprice"), 6).alias("x")).orderBy(F.desc("x"), "gene").limit(8)
    return top.select("gene").union(part.where("p_size = 50").select("p_brand")).distinct()


@query("worst_best_groups", "WITH s AS (SELECT p_brand AS g, round(avg(p_retailprice), 6) AS x FROM part GROUP BY 1) SELECT * FROM (SELECT 'worst' AS kind, g, x FROM s ORDER BY x, g LIMIT 5) UNION ALL SELECT * FROM (SELECT 'best' AS kind, g, x FROM s ORDER BY x DESC, g LIMIT 3)")
def worst_best_groups(spark, sf_dir):
    """T05."""
    s = v.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("g")).agg(v.r6(F.avg("p_retailprice")).alias("x"))
    take = lambda kind, *order, n: s.orderBy(*order).limit(n).select(F.lit(kind).alias("kind"), "g", "x")
    return take("worst", "x", "g", n=5).unionAll(take("best", F.desc("x"), "g", n=3))


@query("finalists", "WITH d AS (SELECT o_orderpriority AS m, o_custkey % 10 AS f, max(o_totalprice) AS s FROM orders GROUP BY 1, 2), t AS (SELECT m, f, s FROM d ORDER BY s DESC, m, f LIMIT 6) SELECT m, f, round(s, 2) AS s FROM t UNION ALL SELECT 'baseline', -1, round(avg(o_totalprice), 2) FROM orders")
def finalists(spark, sf_dir):
    """The best distinct models, the baseline appended."""
    o = v.table(spark, sf_dir, "orders")
    d = o.groupBy(F.col("o_orderpriority").alias("m"), (F.col("o_custkey") % 10).alias("f")).agg(F.max("o_totalprice").alias("s"))
    base = o.agg(F.lit("baseline").alias("m"), F.lit(-1).cast("long").alias("f"), F.avg("o_totalprice").alias("s"))
    return d.orderBy(F.desc("s"), "m", "f").limit(6).unionAll(base).select("m", "f", F.round("s", 2).alias("s"))


@query("claim_next", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 8")
def claim_next(spark, sf_dir):
    """The head of the work queue: priority, then age."""
    return v.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(8).select("o_orderkey", "o_orderpriority")


@query("leaderboard_nulls_last", "SELECT c_custkey, round(s, 2) AS score FROM (SELECT c_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY 1) ORDER BY s DESC NULLS LAST, c_custkey LIMIT 50")
def leaderboard_nulls_last(spark, sf_dir):
    """T08."""
    c, o = v.table(spark, sf_dir, "customer").where("c_nationkey = 3"), v.table(spark, sf_dir, "orders")
    s = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("s"))
    return s.orderBy(F.col("s").desc_nulls_last(), "c_custkey").limit(50).select("c_custkey", F.round("s", 2).alias("score"))


@query("best_completed", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1")
def best_completed(spark, sf_dir):
    """Highest score, the earliest finish wins ties."""
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct(-F.col("o_totalprice"), "o_orderdate", "o_orderkey"))
    return v.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(best.alias("b")).select("o_orderpriority", "b.o_orderkey", "b.o_totalprice")


COSINE = """u AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT u.vec_id AS a, x.vec_id AS b, round(list_cosine_similarity(u.e::DOUBLE[], x.embedding::DOUBLE[]), 9) AS s FROM u JOIN embeddings x ON x.label = u.label AND x.vec_id <> u.vec_id)"""


@query("cosine_knn", f"WITH {COSINE} SELECT a, b, r FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM c) WHERE r <= 3")
def cosine_knn(spark, sf_dir):
    """For a stated query set (ids divisible by 50), the three nearest of all rows of the label."""
    e = v.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x))
    e = e.withColumn("n", norm("e"))
    q = e.where("vec_id % 50 = 0").selectExpr("vec_id as a", "label", "e as qe", "n as qn")
    dot = F.aggregate(F.zip_with("qe", "e", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    c = e.selectExpr("vec_id as b", "label", "e", "n").join(q, "label").where("a <> b").select("a", "b", F.round(dot / (F.col("qn") * F.col("n")), 9).alias("s"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b")).cast("long")).where("r <= 3").drop("s")


@query("correlated_columns", "SELECT i, j, round(r, 6) AS r FROM (SELECT 'quantity' AS i, 'extendedprice' AS j, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'quantity', 'discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'discount', 'tax', corr(l_discount, l_tax) FROM lineitem UNION ALL SELECT 'extendedprice', 'tax', corr(l_extendedprice, l_tax) FROM lineitem) ORDER BY abs(r) DESC, i, j LIMIT 2")
def correlated_columns(spark, sf_dir):
    """The most correlated column pairs, one pass."""
    pairs = [("quantity", "extendedprice"), ("quantity", "discount"), ("discount", "tax"), ("extendedprice", "tax")]
    row = v.table(spark, sf_dir, "lineitem").agg(*(F.corr(f"l_{i}", f"l_{j}").alias(f"{i}-{j}") for i, j in pairs))
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{i}-{j}").alias("r")) for i, j in pairs))
    return row.select(F.inline(table)).orderBy(F.abs("r").desc(), "i", "j").limit(2).select("i", "j", v.r6("r").alias("r"))


@query("enrichment_topk", "SELECT source, hit, n FROM (SELECT source, count(*) FILTER (n_chars > 3000) AS hit, count(*) AS n FROM documents GROUP BY 1) WHERE hit >= 3 ORDER BY hit::DOUBLE / n DESC, hit DESC, source LIMIT 6")
def enrichment_topk(spark, sf_dir):
    """The groups with the largest share of hits, at least three."""
    g = v.table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 3000).alias("hit"), F.count("*").alias("n")).where("hit >= 3")
    return g.orderBy((F.col("hit") / F.col("n")).desc(), F.desc("hit"), "source").limit(6)


@query("disagreement_rows", f"WITH {v.LOO} SELECT pert, gene, r, round(abs(pred - delta), 6) AS gap, abs(delta) >= 0.05 AS detectable FROM (SELECT *, row_number() OVER (PARTITION BY pert ORDER BY round(abs(pred - delta), 9) DESC, gene) AS r FROM loo) WHERE r <= 4")
def disagreement_rows(spark, sf_dir):
    """T13."""
    gap = F.abs(F.col("pred") - F.col("delta"))
    r = F.row_number().over(Window.partitionBy("pert").orderBy(F.round(gap, 9).desc(), "gene")).cast("long")
    return v.loo_mean(v.delta_view(spark, sf_dir)).select("pert", "gene", r.alias("r"), v.r6(gap).alias("gap"), (F.abs("delta") >= 0.05).alias("detectable")).where("r <= 4")


@query(
    "matched_negatives",
    "WITH c AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part WHERE p_size = 1), n AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY sha256(p_partkey::VARCHAR)) AS r FROM part WHERE p_size > 1) SELECT c.p_partkey AS candidate, n.p_partkey AS negative FROM c JOIN n ON n.p_type = c.p_type AND n.r = c.r",
)
def matched_negatives(spark, sf_dir):
    """Each candidate takes an unused pool member of its stratum, in hash order."""
    part = v.table(spark, sf_dir, "part")
    rank = lambda order: F.row_number().over(Window.partitionBy("p_type").orderBy(order))
    c = part.where("p_size = 1").select(F.col("p_partkey").alias("candidate"), "p_type", rank("p_partkey").alias("r"))
    n = part.where("p_size > 1").select(F.col("p_partkey").alias("negative"), "p_type", rank(F.sha2(F.col("p_partkey").cast("string"), 256)).alias("r"))
    return c.join(n, ["p_type", "r"]).select("candidate", "negative")


@query("section_truncate", "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE regexp_replace(substr(text, 1, 400), '\\n[^\\n]*$', '') END AS section FROM documents")
def section_truncate(spark, sf_dir):
    """Cut at a character budget, back to a line boundary."""
    cut = F.regexp_replace(F.substring("text", 1, 400), r"\n[^\n]*\z", "")
    return v.table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") <= 400, F.col("text")).otherwise(cut).alias("section"))


@query("common_keys", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def common_keys(spark, sf_dir):
    """U02."""
    o = v.table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("added_knowledge", "SELECT p_brand FROM part WHERE p_size > 48 EXCEPT SELECT p_brand FROM part WHERE p_type = 'PROMO' AND p_size < 3")
def added_knowledge(spark, sf_dir):
    """U03."""
    p = v.table(spark, sf_dir, "part")
    return p.where("p_size > 48").select("p_brand").subtract(p.where("p_type = 'PROMO' and p_size < 3").select("p_brand"))


@query("partition_check", "SELECT count(*) AS keys, count(*) FILTER (n <> 1) AS wrong FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)")
def partition_check(spark, sf_dir):
    """Folds by key cover every key once."""
    folds = v.table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(5)).alias("fold"))
    return folds.groupBy("o_orderkey").agg(F.count("fold").alias("n")).agg(F.count("*").alias("keys"), F.count_if(F.col("n") != 1).alias("wrong"))


@query("symmetric_difference", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS listed FROM (SELECT doc_id FROM documents WHERE n_chars > 2000) a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def symmetric_difference(spark, sf_dir):
    """U05."""
    a = v.table(spark, sf_dir, "documents").where("n_chars > 2000").select("doc_id", F.lit(True).alias("listed"))
    b = v.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("there"))
    return a.join(b, "doc_id", "full_outer").where("listed is null or there is null").select("doc_id", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("duplicate_config", "SELECT o_orderkey, sha256(o_custkey || '|' || o_orderpriority) IN (SELECT sha256(o_custkey || '|' || o_orderpriority) FROM orders WHERE o_orderstatus = 'F') AS duplicate FROM orders WHERE o_orderstatus = 'P'")
def duplicate_config(spark, sf_dir):
    """Is a pending row's configuration hash among the finished ones?"""
    o = v.table(spark, sf_dir, "orders").withColumn("h", F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256))
    live = o.where("o_orderstatus = 'F'").select("h").distinct().withColumn("live", F.lit(True))
    return o.where("o_orderstatus = 'P'").join(live, "h", "left").select("o_orderkey", F.coalesce("live", F.lit(False)).alias("duplicate"))


@query(
    "prediction_hash",
    "WITH h AS (SELECT l_orderkey AS run, sha256(array_to_string(list_sort(list(l_linenumber || ':' || l_quantity::BIGINT)), ',')) AS h FROM lineitem GROUP BY 1) SELECT run, row_number() OVER (PARTITION BY h ORDER BY run) > 1 AS duplicate FROM h",
)
def prediction_hash(spark, sf_dir):
    """Rows with the same prediction hash collapse; the first stays."""
    item = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("long").cast("string"))
    h = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), ","), 256).alias("h"))
    return h.select("run", (F.row_number().over(Window.partitionBy("h").orderBy("run")) > 1).alias("duplicate"))
