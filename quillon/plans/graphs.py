"""Graph and knowledge operators (G rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators.graph import closure, components, weakest_links

from . import views as v
from .registry import query


@query(
    "ontology_closure",
    "WITH RECURSIVE e AS (SELECT o_orderkey AS c, o_orderkey // 8 AS p FROM orders WHERE o_orderkey >= 8 UNION SELECT o_orderkey, o_orderkey // 12 FROM orders WHERE o_orderkey >= 12), a AS (SELECT c, p FROM e UNION SELECT a.c, e.p FROM a JOIN e ON e.c = a.p) SELECT c, p AS ancestor FROM a WHERE c <> p",
)
def ontology_closure(spark, sf_dir):
    """All ancestors over several parents; a term's parents are its key by 8 and by 12."""
    o = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("c"))
    edges = o.where("c >= 8").selectExpr("c", "c div 8 as p").union(o.where("c >= 12").selectExpr("c", "c div 12 as p"))
    return closure(edges, "c", "p")


@query(
    "connected_components",
    """WITH RECURSIVE n AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER w AS b, epoch(lead(o_orderdate) OVER w) - epoch(o_orderdate) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT a, b FROM n WHERE gap <= 60 * 86400), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1""",
)
def connected_components(spark, sf_dir):
    """The smallest node of each component; a customer's next order within 60 days is a neighbour."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    e = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b"), (F.lead(at).over(w) - at).alias("gap")).where(F.col("gap") <= 60 * 86400 * 1_000_000)
    return components(e, "a", "b")


@query("weakest_link")
def weakest_link(spark, sf_dir):
    """Weakest edge of a maximum spanning tree."""
    e = v.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("grp"), (F.col("l_partkey") % 15).alias("a"), (F.col("l_orderkey") % 15).alias("b"), (F.col("l_discount") + F.col("l_quantity") / 100).alias("w"))
    return weakest_links(e.where("a < b")).select("grp", F.col("nodes").cast("int").alias("nodes"), v.r6("weakest").alias("weakest"))


@query("neighbour_groups", "WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS a, 'P' || l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT a AS node, count(*) AS size FROM u WHERE a <> b GROUP BY 1 HAVING count(*) >= 5")
def neighbour_groups(spark, sf_dir):
    """Neighbour sets over both edge directions."""
    e = v.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("a"), F.concat(F.lit("P"), F.col("l_partkey")).alias("b")).distinct()
    u = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
    return u.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("size")).where("size >= 5")


@query("paralog_pairs", "SELECT least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b, max(l_quantity) AS identity, min(l_shipdate)::DATE::VARCHAR AS first FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50 GROUP BY 1, 2")
def paralog_pairs(spark, sf_dir):
    """Undirected pairs, largest identity, first attribute."""
    a, b = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    return v.table(spark, sf_dir, "lineitem").where(a != b).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max("l_quantity").alias("identity"), F.min("l_shipdate").cast("date").cast("string").alias("first"))


@query("class_membership", "SELECT p_type AS set_name, count(*) AS size FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size = 50) AND regexp_matches(p_type, '^[A-Z]') GROUP BY 1")
def class_membership(spark, sf_dir):
    """Sets that hold a panel target (the parts of the largest size)."""
    part = v.table(spark, sf_dir, "part")
    held = part.where("p_size = 50").select("p_type")
    return part.join(held, "p_type", "left_semi").where(F.col("p_type").rlike("^[A-Z]")).groupBy(F.col("p_type").alias("set_name")).agg(F.count("*").alias("size"))


@query("target_extraction", "SELECT DISTINCT l_partkey AS target FROM lineitem")
def target_extraction(spark, sf_dir):
    """G08."""
    return v.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("target")).distinct()


@query("target_coexpression", f"WITH {v.DELTA} SELECT a.gene AS a, b.gene AS b, round(abs({v.sql_pearson('a.delta', 'b.delta')}), 6) AS r FROM delta a JOIN delta b ON a.pert = b.pert AND a.gene < b.gene GROUP BY 1, 2")
def target_coexpression(spark, sf_dir):
    """Absolute correlation of measures over groups; 0 for a constant one."""
    d = v.delta_view(spark, sf_dir).select("pert", "gene", "delta")
    pairs = d.selectExpr("gene as a", "pert", "delta as x").join(d.selectExpr("gene as b", "pert", "delta as y"), "pert").where("a < b")
    return pairs.groupBy("a", "b").agg(v.r6(F.abs(stats.pearson(F.col("x"), F.col("y")))).alias("r"))


@query("knowledge_assembly", "SELECT gene, count(*) AS facts, count(DISTINCT source) AS sources FROM (SELECT p_brand AS gene, 'size' AS source FROM part WHERE p_size < 10 UNION ALL SELECT p_brand, 'price' FROM part WHERE p_retailprice > 1000 UNION ALL SELECT p_brand, 'type' FROM part WHERE p_type = 'PROMO') GROUP BY 1")
def knowledge_assembly(spark, sf_dir):
    """Sources with their provenance, one scan."""
    facts = F.array_compact(F.array(F.when(F.col("p_size") < 10, "size"), F.when(F.col("p_retailprice") > 1000, "price"), F.when(F.col("p_type") == "PROMO", "type")))
    rows = v.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene"), F.explode(facts).alias("source"))
    return rows.groupBy("gene").agg(F.count("*").alias("facts"), F.count_distinct("source").alias("sources"))


@query("residual_evidence", f"WITH {v.LOO}, e AS (SELECT pert, sqrt(avg((pred - delta) * (pred - delta))) AS rmse, arg_max(gene, round(abs(pred - delta), 9)) AS worst FROM loo GROUP BY 1) SELECT pert, round(rmse, 6) AS rmse, worst FROM e ORDER BY rmse DESC LIMIT 6")
def residual_evidence(spark, sf_dir):
    """The worst groups and their worst measure."""
    e = F.col("pred") - F.col("delta")
    g = v.loo_mean(v.delta_view(spark, sf_dir)).groupBy("pert").agg(v.r6(F.sqrt(F.avg(e * e))).alias("rmse"), F.max_by("gene", F.round(F.abs(e), 9)).alias("worst"))
    return g.orderBy(F.desc("rmse"), "pert").limit(6)


@query(
    "residual_kinds",
    f"""WITH {v.LOO}, r AS (SELECT *, pred - delta AS e FROM loo), g AS (SELECT pert, round(sqrt(avg(e * e)), 9) AS x FROM r GROUP BY 1), h AS (SELECT gene, sqrt(avg(e * e)) AS x, any_value(control_mean) AS c FROM r GROUP BY 1),
o AS (SELECT a.gene AS i, b.gene AS j, round(abs({v.sql_pearson('a.e', 'b.e')}), 9) AS x FROM r a JOIN r b ON a.pert = b.pert AND a.gene < b.gene GROUP BY 1, 2)
SELECT * FROM (SELECT 'worst group' AS kind, pert::VARCHAR AS item, round(x, 5) AS value FROM g ORDER BY x DESC, pert LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'goes together', i || ' ' || j, round(x, 5) FROM o ORDER BY x DESC, i, j LIMIT 5)
UNION ALL SELECT 'error with level', 'control mean', round({v.sql_pearson('x', 'c')}, 5) FROM h
UNION ALL SELECT 'sign', 'mean residual', round(avg(e), 5) FROM r""",
)
def residual_kinds(spark, sf_dir):
    """Kinds of evidence in the residuals: the worst groups, measures that err together, errors that go with the level, and their sign."""
    r = v.loo_mean(v.delta_view(spark, sf_dir)).withColumn("e", F.col("pred") - F.col("delta"))
    rmse = F.sqrt(F.avg(F.col("e") * F.col("e")))
    row = lambda kind, item, value: (F.lit(kind).alias("kind"), item.cast("string").alias("item"), F.round(value, 5).alias("value"))
    worst = r.groupBy("pert").agg(F.round(rmse, 9).alias("x")).orderBy(F.desc("x"), "pert").limit(5).select(*row("worst group", F.col("pert"), F.col("x")))
    pairs = r.selectExpr("gene as i", "pert", "e as a").join(r.selectExpr("gene as j", "pert", "e as b"), "pert").where("i < j").groupBy("i", "j").agg(F.round(F.abs(stats.pearson(F.col("a"), F.col("b"))), 9).alias("x"))
    together = pairs.orderBy(F.desc("x"), "i", "j").limit(5).select(*row("goes together", F.concat_ws(" ", "i", "j"), F.col("x")))
    level = r.groupBy("gene").agg(rmse.alias("x"), F.first("control_mean").alias("c")).agg(stats.pearson(F.col("x"), F.col("c")).alias("r")).select(*row("error with level", F.lit("control mean"), F.col("r")))
    sign = r.agg(F.avg("e").alias("m")).select(*row("sign", F.lit("mean residual"), F.col("m")))
    return worst.unionAll(together).unionAll(level).unionAll(sign)


@query("unread_inputs", "WITH c AS (SELECT event_type AS input, count(*) FILTER (value > 99.5) AS reads, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT input, reads, users, reads = 0 AS unread FROM c")
def unread_inputs(spark, sf_dir):
    """G12."""
    c = v.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("input")).agg(F.count_if(F.col("value") > 99.5).alias("reads"), F.count_distinct("user_id").alias("users"))
    return c.withColumn("unread", F.col("reads") == 0)
