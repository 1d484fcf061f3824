"""Registered features on the screen (F rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators.features import REGISTRY, Context, checked

from . import views as v
from .registry import query

TARGETS = "targets AS (SELECT n_nationkey AS pert, 'Brand#' || (n_nationkey % 5 + 1) || (n_nationkey // 5 + 1) AS gene FROM nation)"
EDGES = "edges AS (SELECT DISTINCT 'Brand#' || (l_partkey % 5 + 1) || (l_suppkey % 5 + 1) AS src, 'Brand#' || (l_orderkey % 5 + 1) || (l_linenumber % 5 + 1) AS dst, CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS weight FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)"
SETS = "sets AS (SELECT DISTINCT p_type || p_size % 3 AS set_name, p_brand AS gene FROM part WHERE p_size > 40)"


def context(spark, sf_dir) -> Context:
    brand = lambda a, b: F.concat(F.lit("Brand#"), (a % 5 + 1).cast("int").cast("string"), (b % 5 + 1).cast("int").cast("string"))
    n = F.col("n_nationkey")
    targets = v.table(spark, sf_dir, "nation").select(n.alias("pert"), brand(n, F.floor(n / 5)).alias("gene"))
    line = v.table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.09")
    edges = line.select(brand(F.col("l_partkey"), F.col("l_suppkey")).alias("src"), brand(F.col("l_orderkey"), F.col("l_linenumber")).alias("dst"), F.when(F.col("l_partkey") % 2 == 0, 1.0).otherwise(-1.0).alias("weight")).distinct()
    sets = v.table(spark, sf_dir, "part").where("p_size > 40").select(F.concat("p_type", (F.col("p_size") % 3).cast("string")).alias("set_name"), F.col("p_brand").alias("gene")).distinct()
    return Context(v.delta_view(spark, sf_dir), targets, edges, sets)


ORACLES = {
    "control_mean": "SELECT pert, gene, round(control_mean, 6) AS value FROM delta",
    "mean_response": "SELECT pert, gene, round((sum(delta) OVER (PARTITION BY gene) - delta) / (count(*) OVER (PARTITION BY gene) - 1), 6) AS value FROM delta",
    "is_target": "SELECT d.pert, d.gene, CASE WHEN t.gene IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM delta d LEFT JOIN targets t ON t.pert = d.pert AND t.gene = d.gene",
    "target_level": "SELECT d.pert, d.gene, round(coalesce(l.x, 0), 6) AS value FROM delta d LEFT JOIN (SELECT t.pert, avg(c.control_mean) AS x FROM targets t JOIN (SELECT DISTINCT gene, control_mean FROM delta) c USING (gene) GROUP BY 1) l USING (pert)",
    "network_edge": "SELECT d.pert, d.gene, round(coalesce(h.x, 0), 6) AS value FROM delta d LEFT JOIN (SELECT t.pert, e.dst AS gene, sum(e.weight * c.control_mean) AS x FROM targets t JOIN edges e ON e.src = t.gene JOIN (SELECT DISTINCT gene, control_mean FROM delta) c ON c.gene = t.gene GROUP BY 1, 2) h ON h.pert = d.pert AND h.gene = d.gene",
    "module_share": "SELECT d.pert, d.gene, round(coalesce(h.k::DOUBLE / h.n, 0) * d.control_mean, 6) AS value FROM delta d LEFT JOIN (SELECT o.pert, s.gene, count(*) AS k, max(o.n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY pert) AS n FROM (SELECT DISTINCT t.pert, s.set_name FROM targets t JOIN sets s ON s.gene = t.gene)) o JOIN sets s USING (set_name) GROUP BY 1, 2) h ON h.pert = d.pert AND h.gene = d.gene",
    "response_times_level": "SELECT pert, gene, round((sum(delta) OVER (PARTITION BY gene) - delta) / (count(*) OVER (PARTITION BY gene) - 1) * control_mean, 6) AS value FROM delta",
}


def _feature(name: str):
    @query(f"feature_{name}", f"WITH {v.DELTA}, {TARGETS}, {EDGES}, {SETS} {ORACLES[name]}")
    def run(spark, sf_dir):
        return checked(context(spark, sf_dir).feature(name)).select("pert", "gene", v.r6("value").alias("value"))

    run.__doc__ = f"F01, F04: the registered feature {name}."


for _name in ORACLES:
    if _name not in REGISTRY:
        raise ValueError(_name)
    _feature(_name)


@query(
    "template_coexpression",
    f"WITH {v.DELTA}, {TARGETS} SELECT t.pert, b.gene, round({v.sql_pearson('a.delta', 'b.delta')}, 6) AS value FROM targets t JOIN delta a ON a.gene = t.gene JOIN delta b ON b.pert = a.pert WHERE t.pert <> 0 GROUP BY 1, 2",
)
def template_coexpression(spark, sf_dir):
    """correlation of the target with every measure over the groups."""
    from quillon.functions import stats

    c = context(spark, sf_dir)
    a = c.targets.where("pert <> 0").withColumnRenamed("pert", "t").join(c.delta.select("pert", "gene", F.col("delta").alias("x")), "gene").select("t", "pert", "x")
    return a.join(c.delta.select("pert", "gene", F.col("delta").alias("y")), "pert").groupBy(F.col("t").alias("pert"), "gene").agg(v.r6(stats.pearson(F.col("x"), F.col("y"))).alias("value"))


@query("dataset_line", "WITH k AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) FILTER (n = 1) || ' singles, ' || count(*) FILTER (n = 2) || ' pairs, ' || count(*) FILTER (n > 2) || ' larger' AS line FROM k")
def dataset_line(spark, sf_dir):
    """F24."""
    k = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("n"))
    n = F.col("n")
    return k.agg(F.format_string("%d singles, %d pairs, %d larger", F.count_if(n == 1), F.count_if(n == 2), F.count_if(n > 2)).alias("line"))


@query("template_choice", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'http') THEN 'link' WHEN contains(lower(text), 'the ') THEN 'english' ELSE 'other' END AS template FROM documents")
def template_choice(spark, sf_dir):
    """the first keyword that occurs decides."""
    t = F.lower("text")
    return v.table(spark, sf_dir, "documents").select("doc_id", F.when(F.contains(t, F.lit("license")), "license").when(F.contains(t, F.lit("http")), "link").when(F.contains(t, F.lit("the ")), "english").otherwise("other").alias("template"))


@query(
    "template_similar",
    f"""WITH {v.DELTA}, {TARGETS}, c AS (SELECT a.gene AS g, b.gene AS h, abs({v.sql_pearson('a.delta', 'b.delta')}) AS r FROM delta a JOIN delta b ON a.pert = b.pert GROUP BY 1, 2),
s AS (SELECT x.pert AS p, y.pert AS q, round(avg(c.r), 9) AS w FROM targets x JOIN targets y ON x.pert <> y.pert JOIN c ON c.g = x.gene AND c.h = y.gene WHERE x.pert <> 0 AND y.pert <> 0 GROUP BY 1, 2),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY w DESC, q) AS r FROM s) WHERE r <= 5)
SELECT k.p AS pert, d.gene, round(sum((w + 1e-6) * d.delta) / sum(w + 1e-6), 6) AS value FROM k JOIN delta d ON d.pert = k.q GROUP BY 1, 2""",
)
def template_similar(spark, sf_dir):
    """mean response of the five groups whose targets go most with one's own."""
    from pyspark.sql import Window

    from quillon.functions import stats

    c = context(spark, sf_dir)
    d, t = c.delta.select("pert", "gene", "delta"), c.targets.where("pert <> 0")
    corr = d.selectExpr("gene as g", "pert", "delta as x").join(d.selectExpr("gene as h", "pert", "delta as y"), "pert").groupBy("g", "h").agg(F.abs(stats.pearson(F.col("x"), F.col("y"))).alias("r"))
    s = t.selectExpr("pert as p", "gene as g").join(corr, "g").join(t.selectExpr("pert as q", "gene as h"), "h").where("p <> q").groupBy("p", "q").agg(F.round(F.avg("r"), 9).alias("w"))
    k = s.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("w"), "q"))).where("r <= 5")
    w = F.col("w") + 1e-6
    return k.join(d.withColumnRenamed("pert", "q"), "q").groupBy(F.col("p").alias("pert"), "gene").agg(v.r6(F.sum(w * F.col("delta")) / F.sum(w)).alias("value"))


EXTERNAL = f"""{v.DELTA}, s AS (SELECT norm.* FROM norm JOIN orders ON o_orderkey = cell WHERE o_orderstatus = 'F'), eg AS (SELECT pert, count(DISTINCT cell) AS n FROM s GROUP BY 1),
ex AS (SELECT g.pert, n.gene, coalesce(t.t, 0) / g.n AS mean FROM eg g CROSS JOIN (SELECT DISTINCT gene FROM s) n LEFT JOIN (SELECT pert, gene, sum(x) AS t FROM s GROUP BY 1, 2) t ON t.pert = g.pert AND t.gene = n.gene),
external AS (SELECT a.pert, a.gene, a.mean - c.mean AS e FROM ex a JOIN ex c ON c.pert = 0 AND c.gene = a.gene WHERE a.pert <> 0)"""


def external(spark, sf_dir):
    """(pert, gene, e): the deltas of another screen of the same groups, against its own control."""
    done = v.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("cell"))
    x = v.normalised(v.counts(spark, sf_dir)).join(done, "cell", "left_semi")
    return v.deltas(v.profiles(x)).select("pert", "gene", F.col("delta").alias("e"))


@query(
    "template_external_knn",
    f"""WITH {EXTERNAL}, w AS (SELECT a.pert AS p, b.pert AS q, round({v.sql_pearson('a.e', 'b.e')}, 9) AS w FROM external a JOIN external b ON a.gene = b.gene AND a.pert <> b.pert GROUP BY 1, 2),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY w DESC, q) AS r FROM w WHERE w > 0) WHERE r <= 5)
SELECT k.p AS pert, d.gene, round(sum(w * d.delta) / sum(w), 6) AS value FROM k JOIN delta d ON d.pert = k.q GROUP BY 1, 2""",
)
def template_external_knn(spark, sf_dir):
    """mean response of the five groups that are most alike in another screen."""
    from pyspark.sql import Window

    from quillon.operators.linear import group_correlations

    d = v.delta_view(spark, sf_dir).select("pert", "gene", "delta")
    w = group_correlations(external(spark, sf_dir), "e").select("p", "q", F.round("r", 9).alias("w"))
    k = w.where("w > 0").withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("w"), "q"))).where("r <= 5")
    return k.join(d.withColumnRenamed("pert", "q"), "q").groupBy(F.col("p").alias("pert"), "gene").agg(v.r6(F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("value"))


@query("template_external_direct", f"WITH {EXTERNAL}, m AS (SELECT pert, gene, (sum(delta) OVER (PARTITION BY gene) - delta) / (count(*) OVER (PARTITION BY gene) - 1) AS pred FROM delta) SELECT m.pert, m.gene, round(coalesce(e, pred), 6) AS value FROM m LEFT JOIN external USING (pert, gene)")
def template_external_direct(spark, sf_dir):
    """the group's own row of another screen, the mean response where it has none."""
    loo = v.loo_mean(v.delta_view(spark, sf_dir))
    return loo.join(external(spark, sf_dir), ["pert", "gene"], "left").select("pert", "gene", v.r6(F.coalesce("e", "pred")).alias("value"))


@query("template_external_kernel")
def template_external_kernel(spark, sf_dir):
    """kernel ridge from the groups' rows of another screen to their responses, each group left out."""
    from quillon.operators import linear

    return linear.external_kernel(external(spark, sf_dir).withColumnRenamed("e", "delta"), v.delta_view(spark, sf_dir), [0.1, 1.0, 10.0])


@query(
    "pair_prior_edge",
    f"""WITH {EDGES}, p AS (SELECT l_orderkey AS pert, list_sort(list_distinct(list('Brand#' || (l_partkey % 5 + 1) || (l_suppkey % 5 + 1)))) AS t FROM lineitem GROUP BY 1 HAVING len(list_distinct(list('Brand#' || (l_partkey % 5 + 1) || (l_suppkey % 5 + 1)))) = 2),
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS w FROM edges GROUP BY 1, 2)
SELECT pert, round(coalesce(w, 0.0), 6) AS value FROM p LEFT JOIN u ON u.a = t[1] AND u.b = t[2]""",
)
def pair_prior_edge(spark, sf_dir):
    """the weight of the edge between the two targets of a pair, 0 without one."""
    brand = F.concat(F.lit("Brand#"), (F.col("l_partkey") % 5 + 1).cast("string"), (F.col("l_suppkey") % 5 + 1).cast("string"))
    pairs = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pert")).agg(F.array_sort(F.collect_set(brand)).alias("t")).where(F.size("t") == 2)
    u = context(spark, sf_dir).edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("w"))
    return pairs.select("pert", F.col("t")[0].alias("a"), F.col("t")[1].alias("b")).join(u, ["a", "b"], "left").select("pert", v.r6(F.coalesce("w", F.lit(0.0))).alias("value"))


@query("template_control_components")
def template_control_components(spark, sf_dir):
    """products of a target's and a measure's loadings on the first components of the measures' correlation."""
    from quillon.operators import linear

    c = context(spark, sf_dir)
    wide = c.delta.groupBy("pert").pivot("gene").agg(F.first("delta")).drop("pert")  # measures are a small fixed dimension
    load = linear.components(wide).where("component < 4").select("component", F.col("column").alias("gene"), "loading")
    own = c.targets.join(load, "gene").select("pert", "component", F.col("loading").alias("target_loading"))
    return own.join(load, "component").select("pert", "gene", F.col("component").alias("col"), v.r6(F.col("loading") * F.col("target_loading")).alias("value"))


@query("smoke_checks")
def smoke_checks(spark, sf_dir):
    """every registered feature is finite, varies and repeats."""
    from quillon.operators.features import smoke

    from quillon.operators.graph import cut

    c = context(spark, sf_dir)
    c = Context(*(cut(x) for x in (c.delta, c.targets, c.edges, c.sets)))  # read many times below
    rows = [(n, *smoke(n, Context(c.delta, c.targets, c.edges, c.sets)).values()) for n in ORACLES]  # the registered features
    return spark.createDataFrame(rows, "feature string, finite boolean, varies boolean, deterministic boolean")
